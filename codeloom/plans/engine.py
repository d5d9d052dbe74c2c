"""The engine: syncs a source tree into versioned tables and answers queries on them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import costs, porter, text
from codeloom.functions import tables as table_functions
from codeloom.operators import chunking, embedding, graph, grounding, retrieval, sync, vector_index
from codeloom.plans.progress import Progress, Subscription
from codeloom.runtime import discard, keep, keep_counted, ship
from codeloom.sources import files as source_files
from codeloom.sources.ignore import IgnoreRules
from codeloom.sources.store import BUCKET, Store, bucket_of

SORT = {"postings": ["term"], "chunks": ["path"], "files": ["path"], "edges": ["source"], "imports": ["path"], "vectors": ["chunk_id"], "terms": ["term"]}
BUCKETS, BUCKET_BYTES = (16, 4096), 64 << 20
STATES = ("new", "modified", "unchanged", "deleted")


class NoIndex(LookupError):
    """Nothing has been synced yet."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None, normalize_dotdot: bool = False):
        ship(spark)
        self.spark, self.store = spark, Store(spark, root)
        self.embedder = embedder or embedding.build_embedder()
        self.normalize_dotdot = normalize_dotdot
        self.listeners: list[Callable[[dict], None]] = []
        self.progress, self._running = Progress(), False
        register(spark)

    # ---- writing --------------------------------------------------------------------------------

    def _tell(self, phase: str, percent: float, state: str = "running", error: str = "", **counts: int) -> None:
        """Counts stay in the statuses of a run once they are known."""
        self._counts = {**({} if phase == "scan" else getattr(self, "_counts", {})), **counts}
        status = {"state": state, "phase": phase, "percent": percent, "error": error, "at": time.time(), **self._counts}
        with self.progress.news:  # a new subscriber sees it as the first or as an update
            self.store.put("status", status)
            self.progress.publish(status)
        for f in self.listeners:
            f(status)

    def subscribe(self, idle: float = 1.5) -> Subscription:
        """The status now, then each that follows; ends with a run, or after ``idle`` seconds without
        news while none is under way."""
        return self.progress.subscribe(self.status, lambda: self._running, idle)

    def status(self) -> dict:
        """A run that has not come to its end and is not ours counts as interrupted."""
        now = self.store.get("status", {"state": "idle"})
        if now.get("state") == "running" and not self._running:
            return {**now, "state": "error", "error": "interrupted"}
        return now

    def sync(self, root: str, repo: str | None = None, rules: IgnoreRules | None = None, go_module: str | None = None, **scan) -> dict:
        """Brings the index up to date with the tree at ``root``; the counts of what was done."""
        self._running = True
        try:
            self._tell("scan", 4)
            return self.sync_files(source_files.scan(self.spark, root, rules=rules, **scan), repo or root.rstrip("/").rsplit("/", 1)[-1], go_module)
        except Exception as e:
            self._tell("failed", 0, "error", str(e)[:2000])
            raise
        finally:
            self._running = False

    def sync_files(self, disk: DataFrame, repo: str, go_module: str | None = None) -> dict:
        """``sync`` for files of any origin: ``path, hash, size, loc, language, content``.

        Hashes are compared first.  Contents are then read for what is new or changed, and only the
        buckets that hold such paths are written; without changes, no data is."""
        disk = disk.select("path", "hash", "size", "loc", "language", "content")
        old, manifest = self.store.tables(), self.store.manifest()
        first = "files" not in old
        held, totals = keep_counted(disk if first else disk.drop("content"), files=F.count(F.lit(1)), loc=F.coalesce(F.sum("loc"), F.lit(0)), size=F.coalesce(F.sum("size"), F.lit(0)))
        disk, meta = (held, held.drop("content")) if first else (disk, held)
        known = self.spark.createDataFrame([], "path string, hash string") if first else self.store.frame(old, "files")
        diff, done = keep_counted(sync.changes(meta, known), **{k: F.count_if(F.col("status") == k) for k in STATES})
        told = {"files_total": totals["files"], "files_changed": done["new"] + done["modified"]}
        same_model = manifest.get("embedder") == self.embedder.name
        # how the edges are found beside the files' own imports
        how = [repo, go_module, self.normalize_dotdot]
        if not first and same_model and manifest.get("how") == how and done["unchanged"] == sum(done.values()):
            stats = {**manifest["stats"], "chunks_done": 0}
            self.store.publish(old, {**manifest, "stats": stats, "at": time.time()})
            discard(held, diff)
            self.record_cost("indexing", 0, 0.0, self.embedder.name)
            self._tell("done", 100, "done", **told)
            return {**done, **stats}
        buckets = manifest.get("buckets") or max(BUCKETS[0], min(BUCKETS[1], totals["size"] // BUCKET_BYTES))
        self._tell("parse", 45, **told)
        at = bucket_of(F.col("path"), buckets)
        stale = diff.filter("status <> 'unchanged'")
        touched = {r[0] for r in stale.select(at).distinct().collect()}  # ``buckets`` at most
        fresh = disk.join(diff.filter("status in ('new', 'modified')").select("path"), "path", "left_semi")
        fresh = fresh if first else keep(fresh)
        terms = F.size(text.index_terms(F.col("content")))
        made, added = keep_counted(chunking.chunk_files(fresh).dropDuplicates(["chunk_id"]).withColumn("terms", terms), chunks=F.count(F.lit(1)), tokens=F.coalesce(F.sum("token_est"), F.lit(0)))

        def change(name: str, rows: DataFrame) -> tuple[DataFrame, set[int] | None]:
            if first:
                return rows.withColumn(BUCKET, at), None
            return sync.purge(self.store.frame(old, name, touched), stale).unionByName(rows).withColumn(BUCKET, at), touched

        words = retrieval.postings(made.select("chunk_id", "path", "content"), "chunk_id", "content", stemmed=True).join(made.select("chunk_id", "path"), "chunk_id")
        per = made.groupBy("path").agg(F.count("*").cast("int").alias("chunk_count"))
        listed = fresh.drop("content").join(per, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("indexed_at", F.lit(time.time()))
        changes = {"files": change("files", listed), "chunks": change("chunks", made), "postings": change("postings", words), "imports": change("imports", graph.imports(fresh.select("path", "content")))}
        tables = self.store.stage(old, changes, SORT)
        self._tell("embed", 90, chunks_done=added["chunks"])
        tables, cells = self._embed(tables, manifest, made, stale, first or not same_model)
        self._tell("graph", 91)
        if touched or manifest.get("how") != how:
            tables = self._link(tables, buckets, how, first)
        chunks = self.store.frame(tables, "chunks")
        figures = chunks.agg(F.count("*"), F.avg("terms")).first()
        languages = {r[0]: r[1] for r in meta.filter("language is not null").groupBy("language").count().orderBy(F.desc("count"), "language").limit(12).collect()}
        stats = {"files": totals["files"], "loc": totals["loc"], "chunks": figures[0], "chunks_done": added["chunks"], "languages": languages}
        self._tell("finalize", 97)
        self._forget_guide(stale)
        self.store.publish(tables, {"repo": repo, "embedder": self.embedder.name, "size": self.embedder.size, "n": figures[0], "avgdl": figures[1] or 0.0, "stats": stats, "at": time.time(), "buckets": buckets, "how": how, **cells})
        discard(*([held] if first else [held, fresh]), diff, made)
        self.record_cost("indexing", added["tokens"], self._price(added["tokens"]), self.embedder.name)
        self._tell("done", 100, "done")
        return {**done, **stats}

    def _embed(self, tables: dict, manifest: dict, made: DataFrame, stale: DataFrame, anew: bool) -> tuple[dict, dict]:
        """Vectors of chunks that have none yet, each in the cell of its nearest centroid.  They are laid
        out by cell; an incremental sync writes the cells that lose or get a vector.  The cells are made
        anew when the embedder changes and when the vectors have become four times as many."""
        n = self.store.frame(tables, "chunks").count()
        if not anew and n > 4 * max(1, manifest.get("cells_of", 0)):
            anew = True
        if anew:
            if self._trained:
                learned = self.embedder.fit(self.store.frame(tables, "chunks"))
                tables = self.store.stage(tables, {"terms": (learned.withColumn(BUCKET, bucket_of(F.col("term"), BUCKETS[0])), None)}, SORT)
                discard(learned)
            vectors = keep(self._vectors(tables, self.store.frame(tables, "chunks")))
            centroids = vector_index.train(vectors, "chunk_id", "embedding", self.embedder.size)
            assigned = vector_index.assign(vectors, "embedding", centroids).withColumnRenamed("cell", BUCKET)
            tables = self.store.stage(tables, {"vectors": (assigned, None)}, SORT)
            probes = vector_index.calibrate(self.store.frame(tables, "vectors", bucket=True).withColumnRenamed(BUCKET, "cell"), centroids, "chunk_id", "embedding", asked=16)
            held = self.spark.createDataFrame([(k, c, 0) for k, c in enumerate(centroids)], f"cell int, centroid array<double>, {BUCKET} int")
            tables = self.store.stage(tables, {"centroids": (held, None)})
            discard(vectors)
            return tables, {"probes": probes, "cells_of": n}
        cells = {k: manifest[k] for k in ("probes", "cells_of")}
        before = self.store.frame(tables, "vectors", bucket=True)
        theirs = keep(before.join(stale.select("path"), "path", "left_semi"))
        kept = theirs.join(made.select("chunk_id"), "chunk_id", "left_semi")
        new = self._vectors(tables, sync.missing(made, theirs))
        new = keep(vector_index.assign(new, "embedding", self.centroids(tables)).withColumnRenamed("cell", BUCKET))
        touched = {r[0] for r in theirs.join(kept.select("chunk_id"), "chunk_id", "left_anti").select(BUCKET).union(new.select(BUCKET)).distinct().collect()}  # cells at most
        if touched:
            rest = sync.purge(self.store.frame(tables, "vectors", touched, bucket=True), stale).unionByName(kept.filter(F.col(BUCKET).isin(list(touched))))
            tables = self.store.stage(tables, {"vectors": (rest.unionByName(new), touched)}, SORT)
        discard(theirs, new)
        return tables, cells

    @property
    def _trained(self) -> bool:
        return getattr(self.embedder, "trained", False)

    def _vectors(self, tables: dict, chunks: DataFrame) -> DataFrame:
        return self.embedder.embed_chunks(chunks, self.store.frame(tables, "terms")) if self._trained else embedding.embed_chunks(chunks, self.embedder)

    def centroids(self, tables: dict) -> list[list[float]]:
        """Of the vectors' cells; ``vector_index.MOST_CELLS`` at most."""
        return [r.centroid for r in self.store.frame(tables, "centroids").orderBy("cell").collect()]

    def _link(self, tables: dict, buckets: int, how: list, first: bool) -> dict:
        """Edges from all files' imports, since a new file may be what others mean; only buckets in which
        they differ are written."""
        edges = graph.resolve(self.store.frame(tables, "imports"), self.store.frame(tables, "files").select("path"), *how).withColumn(BUCKET, bucket_of(F.col("source"), buckets))
        if first or "edges" not in tables:
            return self.store.stage(tables, {"edges": (edges, None)}, SORT)
        edges = keep(edges)
        mark = lambda df: df.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "target", "kind").cast("decimal(38,0)")).alias("mark"))
        now, before = mark(edges), mark(self.store.frame(tables, "edges", bucket=True))
        both = now.alias("a").join(before.alias("b"), F.col(f"a.{BUCKET}") == F.col(f"b.{BUCKET}"), "full_outer")
        other = both.filter(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.mark").eqNullSafe(F.col("b.mark")))).select(F.coalesce(f"a.{BUCKET}", f"b.{BUCKET}"))
        touched = {r[0] for r in other.collect()}
        tables = self.store.stage(tables, {"edges": (edges.filter(F.col(BUCKET).isin(list(touched))), touched)}, SORT)
        discard(edges)
        return tables

    def _price(self, tokens: int) -> float:
        """What embedding so many tokens costs with the embedder's provider; nothing for a local one."""
        if getattr(self.embedder, "provider", "local") == "local":
            return 0.0
        return self.spark.range(1).select(costs.indexing_cost(F.lit(int(tokens)))).first()[0]

    def _forget_guide(self, stale: DataFrame) -> None:
        """Drops the stored guide when a file that it rests on has changed or gone."""
        rests = self.store.get("onboarding").get("files", [])
        if rests and not stale.filter(F.col("path").isin(rests)).isEmpty():
            self.store.put("onboarding", {})

    def record_cost(self, stage: str, tokens: int, usd: float, detail: str = "") -> None:
        self.store.append("costs", self.spark.createDataFrame([(stage, detail, int(tokens), float(usd), time.time())], "stage string, detail string, tokens long, cost_usd double, created double"))

    # ---- reading --------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise NoIndex(name)
        return df

    def views(self) -> None:
        for name in ("files", "chunks", "postings", "vectors", "imports", "edges"):
            self.table(name).createOrReplaceTempView(name)

    def search(self, query: str, n: int = 12, exact: bool = False) -> DataFrame:
        """Hybrid search: ``chunk_id, path, start_line, end_line, language, symbols, content, score,
        sources``.  Without an index, or for a query without words, no rows.  Vectors are looked for in
        the cells nearest to the query, in all where ``exact`` is set."""
        n = max(1, min(int(n), 100))
        version, manifest = self.store.current(), self.store.manifest()
        if version is None:
            return self.spark.createDataFrame([], f"chunk_id string, path string, start_line int, end_line int, language string, symbols array<{chunking.SYMBOL}>, content string, score double, sources array<string>")
        tables = manifest["tables"]
        chunks = self.store.frame(tables, "chunks")
        legs = [("fts", retrieval.bm25_indexed(self.store.frame(tables, "postings"), (manifest["n"], manifest["avgdl"]), "chunk_id", retrieval.stemmed_phrases(query)))]
        if manifest["embedder"] == self.embedder.name:
            probe = self.embedder.embed_query(self.store.frame(tables, "terms"), query) if self._trained else self.embedder.embed([query])[0]
            if any(probe):
                cells = None if exact else {*vector_index.nearest_cells(self.centroids(tables), probe, manifest["probes"])}
                legs.append(("vector", retrieval.nearest(self.store.frame(tables, "vectors", cells), "chunk_id", "embedding", probe)))
        fused = retrieval.fuse(legs, "chunk_id")
        hits = chunks.join(F.broadcast(fused), "chunk_id")  # the legs' limits bound it
        top = retrieval.ranked(retrieval.boost_definitions(hits, F.col("symbols.name"), query), "chunk_id", n)
        return top.select("chunk_id", "path", "start_line", "end_line", "language", "symbols", "content", "score", "sources")

    def repo_map(self, max_nodes: int = 60, max_links: int = 140) -> dict[str, DataFrame]:
        return graph.repo_map(self.spark, self.table("files").select("path", "language", "loc", "chunk_count"), self.table("edges"), max_nodes, max_links)

    def symbols(self, path: str) -> DataFrame:
        rows = self.table("chunks").filter(F.col("path") == path).select(F.explode("symbols").alias("s")).select("s.kind", "s.name", "s.line")
        return rows.distinct().orderBy("line", "name")

    def file_window(self, root: str, path: str, start: int = 1, end: int | None = None, most: int | None = 160) -> dict:
        """Lines of a file below ``root``; ``ValueError`` for a path that leads out of it."""
        parts = path.split("/")
        if path.startswith("/") or ".." in parts or "" in parts or "\\" in path or ":" in parts[0]:
            raise ValueError("the path leads out of the tree")
        rows = self.spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select(F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
        return rows.select(text.file_window(F.col("t"), F.lit(start), F.lit(end) if end is not None else None, most).alias("w")).first().w.asDict()

    def context(self, hits: DataFrame, most: int = grounding.CONTEXT_CHARS) -> str:
        from pyspark.sql import Window

        rows = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
        return grounding.render_context(grounding.context_rows(rows, most)).first().context or ""

    def validate(self, answer: str, hits: DataFrame) -> tuple[str, list[dict]]:
        """The answer with citations of files outside the context demoted, and the valid ones."""
        paths = [r.path for r in hits.select("path").distinct().collect()]
        known = F.array(*map(F.lit, paths)) if paths else F.array().cast("array<string>")
        row = self.spark.createDataFrame([(answer,)], "t string").select(text.demote(F.col("t"), known).alias("t"), F.filter(text.citations(F.col("t")), lambda c: F.array_contains(known, c["path"])).alias("c")).first()
        return row.t, [c.asDict() for c in row.c]

    def chat(self, question: str, history: list[tuple[str, str]], answer: Callable[[list[dict[str, str]]], Iterator[str]], system: str = "", n: int = 12) -> Iterator[dict]:
        """Events: the context, the tokens of ``answer``, then the checked whole or an error."""
        hits = self.search(question, n)
        hits = keep(hits) if self.store.current() else hits
        yield {"type": "context", "chunks": [json.loads(x) for x in hits.drop("content").toJSON().collect()]}
        said = ""
        try:
            for token in answer(grounding.messages(system, history, self.context(hits), question)):
                said += token
                yield {"type": "token", "text": token}
        except Exception as e:
            yield {"type": "error", "error": str(e)}
            return
        clean, valid = self.validate(said, hits)
        yield {"type": "done", "answer": clean, "citations": valid, "tokens": (len(question) + len(said)) // 4}

    def costs(self) -> DataFrame:
        rows = self.store.log("costs")
        return grounding.cost_summary(rows if rows is not None else self.spark.createDataFrame([], "stage string, tokens long, cost_usd double"))

    def onboarding(self, answer: Callable[[list[dict[str, str]]], Iterator[str]] | None = None, system: str = "", provider: str = "ollama", model: str = "") -> dict:
        """Facts and files for a guide; with ``answer`` the guide itself, stored with the files that it
        rests on, its tokens and what they cost with the provider."""
        found = self.repo_map()
        scored = self.table("files").join(found["top_files"].select("path", "score"), "path", "left").select("path", "loc", F.coalesce("score", F.lit(0.0)).alias("score"))
        chosen = [r.path for r in grounding.onboarding_files(scored).orderBy("place").collect()]
        facts = {"stats": self.store.manifest()["stats"], "modules": [r.asDict() for r in found["nodes"].select("id", "files", "loc").limit(24).collect()], "top_files": [r.path for r in found["top_files"].limit(10).collect()], "files": chosen}
        if answer is None:
            return facts
        guide = "".join(answer([{"role": "system", "content": system}, {"role": "user", "content": json.dumps(facts)}]))
        doc = {"key": "onboarding", "content": guide, "model": model, "created": time.time(), "tokens": (len(system) + len(json.dumps(facts)) + len(guide)) // 4, "files": sorted({*chosen, *facts["top_files"]})}
        self.store.put("onboarding", doc)
        usd = self.spark.range(1).select(costs.actual(F.lit(provider), F.lit(model), F.lit(doc["tokens"]))).first()[0]
        self.record_cost("docs", doc["tokens"], usd, model)
        return {**doc, "cost_usd": usd}

    def cached_guide(self) -> dict:
        return self.store.get("onboarding")

    def cost_estimate(self, provider: str, model: str) -> float:
        return self.spark.range(1).select(costs.estimate(F.lit(provider), F.lit(model))).first()[0]


def register(spark: SparkSession) -> None:
    """SQL functions ``detect_language`` and ``loc_of``, which are expanded into plans, ``porter_stem``
    for vocabularies, and the table functions of ``functions.tables``."""
    table_functions.register(spark)
    spark.udf.register("porter_stem", porter.porter_stem)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loc_of(t STRING) RETURNS BIGINT RETURN length(t) - length(replace(t, '\n', '')) + 1")
    entry = lambda kv: ", ".join(f"'{k}', '{v}'" for k, v in kv.items())
    ends = {e: lang for lang, es in text.LANGUAGES.items() for e in es}
    name = "lower(substring_index(p, '/', -1))"
    end = f"CASE WHEN {name} RLIKE '^.+[.][^.]+$' THEN substring_index({name}, '.', -1) ELSE '' END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_language(p STRING) RETURNS STRING RETURN coalesce(try_element_at(map({entry(text.NAMES)}), {name}), try_element_at(map({entry(ends)}), {end}))")
