"""Pages, conversations, near duplicates, vectors, toxicity, personal data and audio."""

import hashlib
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import common, components, op1_html, op3_chat, op4_jaccard, op5_topk, op6_toxicity, op7_pii, op10_audio

DATA = "/root/testdata/sf0.001"


# ---- pages


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice"><p>We use cookies to keep this long sentence around for testing.</p></div>
    <article><h1>Caf&eacute; &amp; bar</h1><p>First <b>bold</b>ly &#x41;<br>next   line.<p>Second one &lt;tag&gt; with a <a href=x>link</a> in it.
    <form><input><label>Mail me</label></form><aside>Side words here.</aside><ul><li>Item one<li>Item two</ul>
    <section id="comments"><article class="comment"><p>I am a reader and this is what I think of it all.</p></article></section></article>
    <div class="sidebar">Popular things</div><footer>&copy; someone</footer></body></html>"""
    assert op1_html.main_text(page) == "Café & bar First boldly A next line. Second one <tag> with a link in it. Item one Item two"
    assert op1_html.main_text(None) == op1_html.main_text("") == op1_html.main_text("<p><!-- open") == ""
    plain = "<body><div class=menu><a href=1>a</a> <a href=2>b</a></div><p>" + "A page without an article has text all the same. " * 3 + "</p></body>"
    assert op1_html.main_text(plain).startswith("A page without")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=9), st.data())
def test_cut_is_minimal(lean, data):
    n = len(lean)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 15)).filter(lambda e: e[0] != e[1]), max_size=14))
    cost = lambda label: sum(-x if k and x < 0 else x if not k and x > 0 else 0 for k, x in zip(label, lean, strict=True)) + sum(w for i, j, w in edges if label[i] != label[j])
    best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
    assert cost(op1_html.minimum_cut(lean, edges)) == best


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-abp\"'= &;", max_size=80))
def test_broken_pages(page):
    op1_html.main_text(page)


def test_extract_columns(spark):
    df = spark.createDataFrame([(1, "<p>" + "Words in a text that is long enough to be one. " * 2, "x"), (2, None, "y")], "page_id long, html string, text string")
    assert [(r.page_id, r.n_chars > 0, r.text == "") for r in op1_html.extract_text(df).orderBy("page_id").collect()] == [(1, True, False), (2, False, True)]


SENTENCE = "The river rose in the night and the men of the village carried sacks of sand to the wall. "
PAGES = [  # html, main text; the labelled pages
    (f'<body><nav><a href=/>Home</a></nav><article class="recipe-menu"><h1>Soup</h1><p>{SENTENCE * 2}</p></article><footer>(c) x</footer>', f"Soup {SENTENCE}{SENTENCE}"),
    (f'<body><article><h1>T</h1><p>{SENTENCE}</p><div class="related-work"><p>{SENTENCE}Earlier work</p></div><p>{SENTENCE}</p></article>', f"T {SENTENCE}{SENTENCE}Earlier work {SENTENCE}"),
    (f'<body><p><a href="/x">{SENTENCE}</a></p></body>', SENTENCE),
    (f'<body><article><h1>T</h1><p>{SENTENCE * 3}</p></article><div class="c-list"><p>{SENTENCE} says me.</p><p>Nice text, thanks.</p></div>', f"T {SENTENCE * 3}"),
    (f'<body><article><h1>T</h1><p>{SENTENCE * 3}</p><div id="comments"><p>{SENTENCE * 4}</p></div></article>', f"T {SENTENCE * 3}"),
    (f'<body><article><h1>T</h1><p>{SENTENCE * 3}</p><div class="ad"><p>{SENTENCE}</p></div><p>{SENTENCE}</p></article>', f"T {SENTENCE * 4}"),
    (f'<body><div id="header">My site</div><div class="menu"><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div class="post"><h1>T</h1><p>{SENTENCE * 3}</p><p>Short.</p>Loose text here<p>{SENTENCE}</p></div><div class="sidebar"><p>{SENTENCE}</p></div><div class="cookie-notice">We use cookies. Accept?</div><div class="site-footer">c</div>', f"T {SENTENCE * 3}Short. Loose text here {SENTENCE}"),
    (f'<body><div class="x"><p>{SENTENCE * 3}</p><div>Photo: J. D.</div><p>{SENTENCE * 2}</p><div>12 km</div><p>{SENTENCE}</p></div>', f"{SENTENCE * 3}Photo: J. D. {SENTENCE * 2}12 km {SENTENCE}"),
    (f"<body><main><p>{SENTENCE * 3}</p><section class=comments><article class=comment><p>{SENTENCE}</p></article><article class=comment><p>{SENTENCE * 3}</p></article></section></main>", SENTENCE * 3),
    (f'<body><div class="box"><p>Go on.</p><div>Home | Away</div><div>More</div><div>Less</div></div><main><p>{SENTENCE * 2}</p></main>', SENTENCE * 2),
]


def test_labelled_pages():
    """The article and nothing else, and the cut overrules the classifier where it is wrong."""
    changed = 0
    for page, want in PAGES:
        assert op1_html.main_text(page) == want.strip()
        blocks = op1_html.read_blocks(page)
        lean = op1_html.leanings(blocks)
        assert max(map(abs, lean)) <= op1_html.BOUND
        changed += sum((v > 0) != kept for v, kept in zip(lean, op1_html.minimum_cut(lean, op1_html.smoothness(blocks)), strict=True))
    assert changed >= 4


def test_pages_table(spark):
    """Null, empty, repeated and very long html, extra columns with clashing names, an empty table."""
    long = "<article>" + f"<p>{SENTENCE}</p>" * 20_000
    data = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p></p>", "x"), (4, "u", PAGES[0][0], "x"), (4, "u", PAGES[0][0], "x"), (5, "u", long, "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = op1_html.extract_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 0), (4, len(PAGES[0][1].strip())), (4, len(PAGES[0][1].strip())), (5, 20_000 * len(SENTENCE) - 1)]
    assert all(len(r.text) == r.n_chars for r in got) and op1_html.extract_text(df.limit(0)).count() == 0


# ---- conversations


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "a\\nb", ""]), st.text(alphabet="<|\\>im_endstar\n ", max_size=30)), max_size=6))
def test_format_round_trip(turns):
    text, spans = op3_chat.format_turns(turns)
    assert op3_chat.parse_turns(text) == turns
    assert [op3_chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    #   1 -> 2 -> 4, 1 -> 3; a cycle 7 <-> 8 with 9 below; 10 under a missing parent; a chain of 40
    data = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 4, 2, 1.0), ("t", 3, 1, 5.0), ("t", 7, 8, 0.0), ("t", 8, 7, 0.0), ("t", 9, 8, 0.0), ("t", 10, 99, 0.0), (None, 1, None, 0.0)]
    data += [("u", k, k - 1 if k else None, 1.0) for k in range(40)]
    df = spark.createDataFrame(data, "tree string, node long, parent long, score double").withColumn("role", F.lit("user")).withColumn("text", F.col("node").cast("string"))
    every = op3_chat.best_conversations(df, None).collect()
    got = {(r.tree, r.leaf): ([t.text for t in r.turns], r["rank"]) for r in every}
    assert got == {("t", 4): (["1", "2", "4"], 2), ("t", 3): (["1", "3"], 1), ("u", 39): ([str(k) for k in range(40)], 1)}
    assert {(r.tree, r.leaf) for r in op3_chat.best_conversations(df).collect()} == {("t", 3), ("u", 39)}
    assert op3_chat.best_conversations(df.limit(0)).count() == 0


def test_conversations(spark):
    got = {r.conv_id: r for r in op3_chat.op3_chat_format(spark, DATA).collect()}
    rows = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append(r)
    assert set(got) == {*rows, -1}
    for k, turns in rows.items():
        loss = "".join(t.text for t in turns if t.role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_conversation_rows(spark):
    """Null ids, -1 in the table, repeated rows, null texts, control strings, a very long turn and
    columns with clashing names, against Python's own reading."""
    long = "<|im_end|>" * 40_000 + "<\\|x"
    data = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (None, 1, "assistant", "z"), (-1, 0, "assistant", "own"), (2, None, "system", ""), (2, 0, "assistant", long), (2, 1, "a\nb\\", "<|")]
    table = spark.createDataFrame([(*r, "t", 3) for r in data], "conv_id long, turn long, role string, text string, tree string, node int")
    got = op3_chat.conversation_digest(op3_chat.format_conversations(op3_chat.best_conversations(op3_chat.conversation_messages(table)))).collect()
    assert {r.conv_id: r.n_turns for r in got} == {1: 3, None: 2, -1: 1, 2: 3}
    want = hashlib.sha256(("system\n\n" + f"assistant\n{long}\n" + "a\nb\\\n<|\n").encode()).hexdigest()
    two = next(r for r in got if r.conv_id == 2)
    assert two.turns_sha256 == want and two.loss_chars == len(long) and two.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert op3_chat.conversation_messages(table.limit(0)).count() == 0


def test_conversations_sql(spark, tmp_path):
    extra = spark.createDataFrame([(None, 0, "user", "y"), (-1, 0, "assistant", "own <|"), (-1, 1, "x\\\n<|", None)], "conv_id long, turn long, role string, text string")
    spark.read.parquet(f"{DATA}/conversations.parquet").select(*extra.columns).unionByName(extra).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(op3_chat.SQL).fetchall(), key=str)
    got = op3_chat.op3_chat_format(spark, str(tmp_path))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_repeated_messages(spark):
    df = spark.createDataFrame([("t", 1, None, "user", "a"), ("t", 1, None, "user", "a"), ("t", 2, 1, "user", "b"), ("t", 2, 9, "user", "c")], "tree string, node long, parent long, role string, text string").withColumn("score", F.lit(1.0))
    got = op3_chat.best_conversations(df, None).collect()
    assert [[t.text for t in r.turns] for r in got] == [["a", "a", "b", "c"]]


# ---- near duplicates


def brute_classes(docs):
    sets = []
    for k, (i, t) in enumerate(docs):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i or -1, len(s), least.get(root(k)) or -1) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize("block", [64, 2])
def test_near_duplicates_awkward(spark, rows, block):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in op4_jaccard.near_duplicates(rows, block=block).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in rows.collect()])
    assert op4_jaccard.near_duplicates(rows.limit(0)).count() == 0


def test_near_duplicates_chains(spark):
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(400)]
    docs, i = [], 1
    for _ in range(12):
        text = list(rng.choice(words, rng.integers(6, 120)))
        for _ in range(rng.integers(1, 9)):
            docs.append((i, " ".join(text)))
            i += 1
            for _ in range(rng.integers(0, 3)):
                text[rng.integers(len(text))] = str(rng.choice(words))
    docs += [(i + k, "common line of words that all share " * 3 + " ".join(rng.choice(words, 20))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (64, 3):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op4_jaccard.near_duplicates(df, block=block).collect()) == brute_classes(docs)


def edited_copies(many, seed=5, edits=2):
    """Copies of one text of 100 words with edits at random places: few of their pairs link."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(1, many + 1):
        text = [f"base{k}" for k in range(100)]
        for _ in range(edits):
            text[rng.integers(100)] = f"edit{rng.integers(1 << 30)}"
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize(("many", "block", "edits"), [(420, 64, 2), (90, 3, 3)])
def test_near_duplicates_of_one_group(spark, many, block, edits):
    docs = edited_copies(many, edits=edits)
    docs += [(1000 + k, " ".join(f"base{j}" for j in range(40, 70)) + f" other{k} " + " ".join(f"own{k}x{j}" for j in range(k % 9))) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op4_jaccard.near_duplicates(df, block=block).collect())
    assert got == brute_classes(docs)


def test_rows_sent_grow_with_the_group(spark, monkeypatch):
    sent, before = [], op4_jaccard.verified

    def counting(deals, *more):
        sent.append(deals.agg(F.sum(F.size("deals"))).first()[0] or 0)
        return before(deals, *more)

    monkeypatch.setattr(op4_jaccard, "verified", counting)
    totals = []
    for many in (400, 1600):
        sent.clear()
        op4_jaccard.near_duplicates(spark.createDataFrame(edited_copies(many), "doc_id long, text string")).count()
        totals.append(sum(sent))
    assert totals[1] < 5 * totals[0], totals


def test_difference_prefixes():
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))
    codes, counts = tokens[:30], np.full(30, 8, np.int32)
    got = op4_jaccard.difference(tokens[5:], 10, codes, counts)
    assert sorted(got.tolist()) == sorted({*tokens[5:].tolist()} ^ {*codes.tolist()})
    assert got[-1] in tokens[:5]  # missing in few sampled sets, so behind what none of them holds
    assert op4_jaccard.difference(tokens, 0, codes[:0], counts[:0]).tolist() == tokens.tolist()


def test_long_text_in_stretches(monkeypatch):
    import pyarrow as pa

    text = "Some words\tand more " * 700
    whole = dict(op4_jaccard.shingle_sets(pa.array([text])))
    monkeypatch.setattr(common, "GROUP_BYTES", 500)
    assert (dict(op4_jaccard.shingle_sets(pa.array([text])))[0] == whole[0]).all()


def test_oracle_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(op4_jaccard.SQL).fetchall())
    assert sorted(map(tuple, op4_jaccard.op4_jaccard_join(spark, DATA).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 50_000)] + [(1000, 1000 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got[40] == 0 and got[200] == got[150] == 100 and got[50_000] == 300 and got[1059] == 1000 and len(got) == 41 + 3 + 2 + 60


# ---- vectors


def brute_top_k(data, k):
    """By Python's integers, each row against every other."""
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in data if i is not None and v and all(c is not None and math.isfinite(c) and math.isfinite(256 * c) for c in v)]
    want = []
    for n, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for m, (i, y) in enumerate(rows) if m != n and len(x) == len(y))[:k]
            want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(want)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 4]) for i in range(400)]  # many ties
    data += [(500, None), (550, [1.0, None, 2.0, 1.0]), (600, [float("nan"), 1.0, 1.0, 1.0]), (650, [float("inf"), 0.0, 0.0, 0.0]), (700, []), (None, [1.0, 1.0, 1.0, 1.0]), (750, [1.0, 2.0]), (0, data[0][1]), (0, [0.5, 0.25, 0.1, 3.0])]
    schema = "vec_id long, embedding array<double>, rank string, row string, x string"
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in data], schema)
    for shard, k in ((16_384, 5), (20, 5), (20, 500)):
        got = sorted(map(tuple, op5_topk.top_k(op5_topk.clean(df), k, shard=shard).collect()))
        assert got == brute_top_k(data, k)
    assert op5_topk.top_k(op5_topk.clean(df.limit(0))).count() == 0


def test_top_k_fractions_and_large_values(spark):
    rng = np.random.default_rng(6)
    data = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 9)).tolist()) for i in range(200)]
    data += [(i, (rng.standard_normal(6) * 1e12).tolist()) for i in range(200, 260)] + [(300, [1e300] * 6), (301, [-1e300] * 6), (302, [1e308] * 6), (350, [0.1 / 3] * 6)]
    data += [(400 + i, [2.0**45 + i, -(2.0**45), 1.0, 0.0, 0.0, 0.0]) for i in range(10)]  # sums that rounding would tie
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for shard in (16_384, 20):
        assert sorted(map(tuple, op5_topk.top_k(op5_topk.clean(df), shard=shard).collect())) == brute_top_k(data, 5)


def test_top_k_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert sorted(map(tuple, op5_topk.op5_exact_top_k(spark, DATA).collect())) == sorted(con.sql(op5_topk.SQL).fetchall())


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op6_toxicity.op6_toxicity(spark, at).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    found, toxic, both = sum(p for _, p in held), sum(t for t, _ in held), sum(p and t for t, p in held)
    # some toxic labels of these tables are on texts without insults
    assert toxic and both / toxic >= 0.6 and both / max(found, 1) >= 0.9


def disguised(rng, word):
    k = int(rng.integers(1, len(word)))
    form = rng.integers(6)
    looks = word.replace("o", "0").replace("i", "1").replace("e", "3")
    return [word, f"{word[:k]}{rng.choice(list('xqz'))}{word[k:]}", f"{word[:k]}-{word[k:]}", " ".join(word), looks, f"{word[:k]}{word[k - 1]}{word[k:]}"][form]


def test_toxicity_recall_and_precision():
    """Disguised insults in one sentence of several, some training labels wrong; nobody toxic: fails."""
    rng = np.random.default_rng(8)
    calm = ["".join(rng.choice(list("aeioulnrstdm"), rng.integers(2, 9))) for _ in range(400)]
    insults = ["blockhead", "nitwit", "dunce", "clodpole", "dimwit", "buffoon"]

    def text(toxic):
        sentences = [list(rng.choice(calm, rng.integers(4, 14))) for _ in range(rng.integers(2, 7))]
        if toxic:
            own = sentences[rng.integers(len(sentences))]
            for _ in range(rng.integers(2, 4)):
                own.insert(int(rng.integers(len(own) + 1)), disguised(rng, rng.choice(insults)))
        return "\n".join(" ".join(x) + "." for x in sentences)

    truth = rng.integers(0, 2, 700)
    texts = [text(t) for t in truth]
    labels = np.where(rng.random(700) < 0.04, 1 - truth, truth)
    machine = op6_toxicity.train(list(zip(labels[:500].tolist(), texts[:500], strict=True)))
    found, want = machine.scores(texts[500:]) >= 0.5, truth[500:] == 1
    assert (found & want).sum() / want.sum() >= 0.9 and (found & want).sum() / max(found.sum(), 1) >= 0.9


def test_letters_are_put_back():
    assert [op6_toxicity.bare(w) for w in ("1d10t!", "n1tw1t", "id-iot", "42", "thoner$$$", "$tup1d")] == ["idiot", "nitwit", "idiot", "", "thoner", "tupid"]
    assert op6_toxicity.sentences_of("One two. Three!\n\nfour") == [["one", "two."], ["three!"], ["four"]]


def test_toxicity_tables(spark, tmp_path):
    """Null ids, a score at 0.5, no labels, empty tables, columns that clash."""
    docs = spark.createDataFrame([(1, "a b", 9.0), (None, "a b", 9.0), (2, None, 9.0)], "doc_id long, text string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op6_toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.score, r.predicted) for r in got) == [(0, False, 0.0, 0), (1, zlib.crc32(b"1") % 5 == 0, 0.0, 0), (2, zlib.crc32(b"2") % 5 == 0, 0.0, 0)]
    even = op6_toxicity.Machine(np.zeros(op6_toxicity.ALPHABET**3), -2.0, np.zeros(5))
    assert even.scores(["a b"])[0] == 0.5


def test_toxicity_of_hidden_words(spark):
    rng = np.random.default_rng(2)
    calm = [f"{a}{b}" for a in ("wind", "stone", "lake", "field", "branch") for b in ("ing", "er", "ly", "s", "ed", "ful")]
    bad = ["blockhead", "nitwit", "dunce"]
    text = lambda toxic: " ".join([*rng.choice(calm, 30), *(rng.choice(bad, 3) if toxic else [])])
    machine = op6_toxicity.train([(k % 2, text(k % 2)) for k in range(300)])
    scores = machine.scores([text(0), text(1), text(0) + " you b l o c k h e a d there", text(0) + " such a nitxwit again nitwwit", text(0) + " n.i.t.w.i.t", "", "x" * 100_000, "windi" * 50])
    assert (scores[[1, 2, 3, 4]] > 0.5).all() and (scores[[0, 5, 6]] < 0.5).all()
    assert op6_toxicity.train([(0, "a")]) is None
    df = spark.createDataFrame([(1, None, 3.0), (2, text(1), 3.0), (2, text(1), 3.0)], "doc_id long, text string, score double")
    assert [r.score > 0.5 for r in op6_toxicity.score_texts(df, machine).orderBy("doc_id").collect()] == [False, True, True]
    assert op6_toxicity.score_texts(df.limit(0), machine).count() == 0


def test_toxicity_late_in_long_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    calm = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    text = lambda toxic: " ".join([*rng.choice(calm, 3000), *(["blockhead", "nitwit", "blockhead"] if toxic else ["thanks"])])
    docs = [(k, text(k % 2)) for k in range(60)]
    spark.createDataFrame(docs + docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    machine = op6_toxicity.learned(spark, str(tmp_path))
    assert machine is not None
    assert (machine.scores([t for _, t in docs]) > 0.5).tolist() == [k % 2 == 1 for k in range(60)]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert op6_toxicity.sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).groupBy("doc_id").count().filter("count > 1").count() == 0



def test_margins_equal_the_kernel():
    words = ["blockhead", "bloxckhead", "aa", "aaaa", "ab"]
    marks = op6_toxicity.Landmarks(["blockhead", "nitwit"])

    def slow(a, b):
        def weights(w):
            c, out = op6_toxicity.codes([w])[0].tolist(), {}
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, len(c)):
                        out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + op6_toxicity.DECAY ** (k - i + 1)
            n = sum(v * v for v in out.values()) ** 0.5
            return {t: v / n for t, v in out.items()}

        x, y = weights(a), weights(b)
        return sum(v * y.get(t, 0) for t, v in x.items())

    assert marks.kernel(words) == pytest.approx(np.array([[slow(w, m) for m in marks.words] for w in words]), abs=1e-5)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark, rows):
    rng = np.random.default_rng(4)
    bits = [*"0123456789", *"0123456789", *"a.@+- ()é", "4111111111111111", "4111 1111 1111 1111", "192.168.1.1", "x@y.co", "+1 (555) 555-1234", "0256.1.1.1", "a@b.cd+e@f.g"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(1500)] + ["", None, "1" * 30_000, "a" * 30_000 + "@b.c", "1 " * 20_000] + [r.text for r in rows.collect()]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", op7_pii.shown(op7_pii.base_spans(common.texts())).alias("s"))
    assert [(r.text, r.s) for r in df.collect() if r.s != brute_spans(r.text or "")] == []


def test_personal_data_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(op7_pii.SQL)
    got = op7_pii.op7_pii(spark, DATA)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_revealing_terms(spark, rows):
    filler = "some words that are in all of these texts we write about here "
    docs = [(k, f"{filler} write {w} zorblatt at eva@mail.org about {w}") for k, w in enumerate(["oak", "elm", "ash", "fir"])] + [(4, f"zorblatt {filler} eva@mail.org")] + [(k, f"{filler} nothing {k}") for k in range(5, 60)] + [(99, "zorblatt alone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in op7_pii.find_personal_data(df).collect()}
    assert found[4] == [("term", "zorblatt"), ("email", "eva@mail.org")] and found[0][0] == ("term", "zorblatt")
    assert found[99] == [] and all(found[k] == [] for k in range(5, 60))
    clean = {r.doc_id: r.text for r in op7_pii.sanitise(df).collect()}
    assert clean[4] == f"[REMOVED] {filler} [EMAIL]" and clean[99] == "zorblatt alone"
    kept = op7_pii.sanitise(rows)
    assert kept.columns == rows.columns and kept.count() == rows.count() and kept.filter("text is null").count() == 1
    assert kept.filter("doc_id = 12").first().text == "mail [EMAIL] or [PHONE] now, host [IP], card [CARD]."
    assert op7_pii.sanitise(rows.limit(0)).count() == 0


def test_copies_do_not_hide_revealing_terms(spark):
    filler = "some words that are in all of these texts we write about here"
    copy = f"{filler} zorblatt at eva@mail.org about"
    docs = [(k, copy) for k in range(12)] + [(k, f"{filler} at about nothing {k}") for k in range(12, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in op7_pii.sanitise(df).collect()}
    assert {clean[k] for k in range(12)} == {f"{filler} [REMOVED] at [EMAIL] about"}
    assert all(clean[k] == t for k, t in docs[12:])


def test_revealing_terms_anywhere_in_a_document(spark):
    filler = "some words that are in all of these texts we write about here"
    docs = [(k, f"dear Zo and 王伟 {filler} {filler} eva@mail.org") for k in range(8)] + [(k, f"dear and {filler} nothing {k}") for k in range(8, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in op7_pii.sanitise(df).collect()}
    assert {clean[k] for k in range(8)} == {f"dear [REMOVED] and [REMOVED] {filler} {filler} [EMAIL]"}
    assert all(clean[k] == t for k, t in docs[8:])


def brute_disclosure(docs):
    """All spans of each document, by the definition: counts of documents, PMI against IC."""
    spans = [[(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in brute_spans(t).split(",") if x] for t in docs]

    def key(t, s):
        v = t[s[0] : s[1]]
        return s[2], v.lower() if s[2] == "email" else v if s[2] == "ip" else re.sub("[^0-9]", "", v)

    def outside(t, own):
        return "".join(" " if any(a <= k < b for a, b, _ in own) else c for k, c in enumerate(t))

    words = [set(re.findall(r"[^\W\d_]+", outside(t, own).lower())) for t, own in zip(docs, spans, strict=True)]
    held = [{key(t, s) for s in own} for t, own in zip(docs, spans, strict=True)]
    n, df, times, both = len(docs), {}, {}, {}
    for w, e in zip(words, held, strict=True):
        for x in w:
            df[x] = df.get(x, 0) + 1
        for x in e:
            times[x] = times.get(x, 0) + 1
            for y in w:
                both[x, y] = both.get((x, y), 0) + 1
    out = []
    for t, own, w, e in zip(docs, spans, words, held, strict=True):
        bad = {y for x in e for y in w if times[x] >= 2 and both[x, y] >= 2 and times[x] < n and math.log2(both[x, y] * n / (df[y] * times[x])) >= 0.8 * math.log2(n / times[x])}
        terms = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in bad and not any(m.start() < b and a < m.end() for a, b, _ in own)]
        out.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted([*own, *terms], key=lambda s: (s[0], ["email", "ip", "card", "phone", "term"].index(s[2])))))
    return out


def test_disclosure_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{chr(97 + a)}{chr(97 + b)}é" for a in range(12) for b in range(10)]
    mails = ["ann@x.org", "Bob@y.net", "10.0.0.1", "+1 555 123 4567", "c.d@e.fr"]
    docs = []
    for _ in range(150):
        own = rng.choice(words, rng.integers(0, 12)).tolist()
        if rng.random() < 0.3:
            m = rng.integers(len(mails))
            own += [mails[m]] + [words[m]] * (rng.random() < 0.9) + [words[m + 5].upper()] * (rng.random() < 0.5)
        rng.shuffle(own)
        docs.append(" ".join(own))
    docs += ["", docs[0], docs[3], "ann@x.org 10.0.0.1 " * 700 + words[0]]  # more matches than a stretch holds
    df = spark.createDataFrame([(k, t, "a", "b", "c", 1, 2) for k, t in enumerate(docs)], "doc_id long, text string, base string, spans string, row_key string, terms int, entities int")
    got = {r.doc_id: r.s for r in op7_pii.find_personal_data(df).select("doc_id", op7_pii.shown(F.col("spans")).alias("s")).collect()}
    want = brute_disclosure(docs)
    assert [got[k] for k in range(len(docs))] == want and any("term" in w for w in want)
    clean = op7_pii.sanitise(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        parts, at = [], 0
        for kind, a, b in (x.split(":") for x in want[r.doc_id].split(",") if x):
            if int(b) > at:
                parts += [docs[r.doc_id][at : max(at, int(a))], "[REMOVED]" if kind == "term" else f"[{kind.upper()}]"]
                at = int(b)
        assert r.text == "".join(parts) + docs[r.doc_id][at:]
        assert (r.base, r.spans, r.row_key, r.terms, r.entities) == ("a", "b", "c", 1, 2)


# ---- audio


def test_tables_and_adpcm():
    mu, a = op10_audio.TABLES["mulaw"], op10_audio.TABLES["alaw"]
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256

    def slow(block):
        value, index = struct.unpack_from("<hB", block)
        index, out = min(index, 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                s = op10_audio.IMA_STEP[index]
                d = (s >> 3) + (s >> 2 if code & 1 else 0) + (s >> 1 if code & 2 else 0) + (s if code & 4 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        return out

    blocks = np.random.default_rng(6).integers(0, 256, (40, 64), np.uint8)
    assert op10_audio.adpcm_decode(blocks).tolist() == [slow(b.tobytes()) for b in blocks]
    assert op10_audio.resample_double(np.array([0, 0, 160, 160, 160], np.int16)).tolist()[::2] == [0, 0, 160, 160, 160]


def plain_sound(codec, pcm):
    """The feature by the definition, sample by sample."""
    at = lambda i: int(pcm[min(max(i, 0), len(pcm) - 1)])
    y = []
    for i in range(len(pcm)):
        y += [at(i), max(-32768, min(32767, (9 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4))]
    energy, crossings = sum(v * v for v in y), sum((a < 0) != (b < 0) for a, b in zip(y, y[1:], strict=False))
    return f"{codec}:16000:{len(y)}:{energy // len(y)}:{crossings}:{max(abs(v) for v in y)}", struct.pack(f"<{len(y)}h", *y)


def test_sound_is_that_of_the_whole():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 64, 1000, 4097):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        want, stored = plain_sound("alaw", pcm)
        for window in (1, 2, 7, 64, 1 << 20):
            got = op10_audio.Sound("alaw", pcm, window)
            assert (got.feature, got.sha256, 2 * got.n) == (want, hashlib.sha256(stored).hexdigest(), len(stored))
    long = rng.integers(-32768, 32768, (1 << 21) + 5).astype(np.int16)
    assert op10_audio.Sound("mulaw", long).feature == op10_audio.Sound("mulaw", long, long.size).feature


def test_audio_rows(spark, rows):
    texts = {(r.doc_id, r.text or "") for r in rows.collect()}
    got = op10_audio.audio_digest(rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values()) and len(got) == rows.count()
    for i, t in texts:
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = next(x for x in got if x.doc_id == i and x.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = op10_audio.wav(op10_audio.codec_of(payload), payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and op10_audio.read_wav(media)[1] == payload
        codec, pcm = op10_audio.codec_of(payload), op10_audio.decode_many([media])[0]
        if len(pcm) < 5000:
            feature, stored = plain_sound(codec, pcm)
            assert (r.feature, r.pcm_bytes, r.pcm_sha256) == (feature, len(stored), hashlib.sha256(stored).hexdigest())
    assert op10_audio.audio_digest(rows.limit(0)).count() == 0
    media = spark.createDataFrame([(bytearray(op10_audio.wav(c, bytes(range(64)) * 2)), 1) for c in op10_audio.TAGS] + [(None, 2)], "media binary, pcm int")
    assert sorted(len(r.pcm) if r.pcm is not None else -1 for r in op10_audio.decode_audio(media).collect()) == [-1, 512, 512, 968]
    with pytest.raises(ValueError):
        op10_audio.read_wav(b"RIFFxxxxWAVE")


def test_filter_without_a_worker(spark):
    """The bitmap is read by joins, not by a second Python worker in each task, and misses no row."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3000)] + [(None, "text 0"), (3, None)], "doc_id long, text string")
    wanted = docs.filter("doc_id % 7 = 3").select("doc_id", op4_jaccard.text_key())
    found = op4_jaccard.may_hold(docs, wanted, ["doc_id", "text_key"])
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.text) for r in found.collect())
    want = sorted((r.doc_id, r.text or "") for r in docs.filter("doc_id % 7 = 3").collect())
    assert set(want) <= set(got) and len(got) < len(want) + 5
    known = op4_jaccard.Filter(wanted, ["doc_id", "text_key"])
    holds, keyed = known.holds(), docs.withColumn("text_key", op4_jaccard.text_key())
    rows = known.marked(keyed, "may").withColumn("at", known.place()).select("at", "may").collect()
    assert [r.may for r in rows] == [bool(x) for x in holds(np.array([r.at for r in rows]))] and len(rows) == docs.count()
    assert op4_jaccard.may_hold(docs, wanted.limit(0), ["doc_id"]).count() == 0
