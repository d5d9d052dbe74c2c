"""Operator 6: toxicity by a subsequence string-kernel support vector machine with landmarks.

Words are compared by the gap-weighted subsequence kernel of length 3: every three characters in
order count, times ``DECAY`` to the power of the stretch they cover, so a word with gaps or inserted
characters stays close to the word it hides.  Letters that stand alone in a row are read as one
word, and words carry a mark at either end.

Training sees labelled sentences: the whole texts of documents labelled toxic or not (at most
``per_class`` ids of each label, the bound of the sample) are split into sentences, which carry the
label of their document.  As one insult makes a sentence toxic, the machine is a multi-instance one:
a sentence is the bag of its words, a toxic sentence is represented by its witness, the word that
speaks most for the label, and all words of other sentences are negative examples.  The first
witnesses are words in at least ``MIN_DOCS`` and ``MIN_SHARE`` of the toxic documents that are
``MIN_RATIO`` times as frequent there; in ``ROUNDS`` rounds the machine is fitted, the sentences choose
their witnesses anew by its margin, so that rare and disguised insults join, and up to ``HARD`` words of
other sentences inside the margin are added.  Sentences of toxic documents without a word on the
positive side have no witness and no part.  Insults made of ordinary words only are missed.

Landmarks are drawn from both sides; the Nyström map sends a word to ``K(w, L) K(L, L)^-1/2`` and a
linear machine is fitted there by dual coordinate ascent.  As that function is linear in the kernel, it
folds into one weight for each character triple, and scoring never needs a kernel matrix.  A document's
score is a logistic function of how many and what share of its words the machine takes for insults,
calibrated on the training documents; 0.5 counts as toxic.

Null or empty texts score like a text without hits, and very long ones are read whole.  Labels, language,
source and id are no inputs of a score; rows that repeat score alike; a null id is not held out.
Without labels of both kinds every score is 0; an empty table gives no rows.  Other columns are kept, but
for one named like the score.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

DECAY, WIDEST, ALPHABET = 0.6, 16, 64
PER_CLASS, LANDMARKS, MIN_DOCS, MIN_SHARE, MIN_RATIO, SIGNATURE, ROUNDS, HARD = 2500, 800, 3, 0.012, 8.0, 24, 4, 3000
STEP, MEMO = 1 << 10, 150_000  # words whose triples, and whose margins, a worker holds at once
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?\s+){2,}[^\W\d_](?![^\W_])")
_ENDS = re.compile(r"(?<=[.!?。！？])\s+|\n+")
# Characters that stand for letters inside words.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})


def joined(text: str) -> str:
    """Lower-case, with letters that stand alone in a row as one word."""
    return _SPACED.sub(lambda m: " " + re.sub(r"[\W\d_]+", "", m[0]) + " ", text.lower())


def words_of(text: str) -> list[str]:
    return joined(text).split()


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence; sentences end at a stop before white space and at line ends."""
    return [words for part in _ENDS.split(joined(text)) if (words := part.split())]


def bare(word: str) -> str:
    """The letters of a word; characters inside it that stand for letters are put back."""
    if word.isalpha():
        return word
    word = re.sub(r"^[\W_]+|[\W_]+$", "", word)
    if any(map(str.isalpha, word)):
        word = word.translate(LOOKS)
    return "".join(filter(str.isalpha, word))


def codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length as numbers below ``ALPHABET``: 1 and 2 mark the ends, a to z
    keep places of their own."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), -1)
    ends = np.ones((len(words), 1), np.int64)
    return np.concatenate([ends, np.where((c >= 97) & (c <= 122), c - 94, 29 + c % 35), 2 * ends], 1)


_triples: dict[int, tuple] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if n not in _triples:
        i, j, k = (np.array(x) for x in zip(*combinations(range(n), 3), strict=True))
        _triples[n] = i, j, k, DECAY ** (k - i + 1.0)
    return _triples[n]


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes of words of one length, and the weight of each place."""
    i, j, k, w = triples(rows.shape[1])
    return (rows[:, i] * ALPHABET + rows[:, j]) * ALPHABET + rows[:, k], w


def by_length(words: list[str]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Positions and codes by length; longer words than ``WIDEST`` by overlapping stretches."""
    same: dict[int, list[int]] = {}
    for p, word in enumerate(words):
        if word:
            same.setdefault(len(word), []).append(p)
    found: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for places in same.values():
        rows = codes([words[p] for p in places])
        for a in range(0, max(1, rows.shape[1] - WIDEST // 2), WIDEST // 2):
            part = rows[:, a : a + WIDEST]
            if part.shape[1] >= 3:
                at, kept = found.setdefault(part.shape[1], ([], []))
                at += places
                kept.append(part)
    return {n: (at, np.concatenate(rows)) for n, (at, rows) in found.items()}


def squared_norms(feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """K(w, w): weights of equal triples add up before they are squared."""
    order = np.argsort(feature, 1, kind="stable")
    f, w = np.take_along_axis(feature, order, 1), weight[order]
    new = np.ones(f.shape, bool)
    new[:, 1:] = f[:, 1:] != f[:, :-1]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(w.reshape(-1), at)
    return np.bincount(at // f.shape[1], sums**2, f.shape[0])


class Landmarks:
    """Kernel of any words with a few; only triples that these have need a column."""

    def __init__(self, words: list[str]):
        self.words = words
        used = np.unique(np.concatenate([features(rows)[0].reshape(-1) for _, rows in by_length(words).values()]))
        self.triples = used
        self.column = np.full(ALPHABET**3, -1, np.int64)
        self.column[used] = np.arange(used.size)
        self.own = self._map(words)

    def _map(self, words: list[str]) -> np.ndarray:
        """Normalised weights of these triples, a row for each word."""
        out, norm = np.zeros((len(words), self.triples.size), np.float32), np.zeros(len(words))
        for at, rows in by_length(words).values():
            f, w = features(rows)
            norm[at] += squared_norms(f, w)
            c = self.column[f]
            r, k = np.nonzero(c >= 0)
            np.add.at(out, (np.array(at)[r], c[r, k]), w[k])
        return out / np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)[:, None]

    def kernel(self, words: list[str], step: int = 200) -> np.ndarray:
        return np.concatenate([self._map(words[k : k + step]) @ self.own.T for k in range(0, len(words), step)])


class Machine:
    """What scoring needs: a weight for each triple, the threshold of a hit, and the calibration."""

    def __init__(self, weight: np.ndarray, bias: float, calibration: np.ndarray):
        self.weight, self.bias, self.calibration = weight.astype(np.float32), bias, calibration
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.weight, self.bias, self.calibration

    def __setstate__(self, state):
        self.weight, self.bias, self.calibration = state
        self.memo = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; below -0.5 only a bound is given, which is as good for counting."""
        out = np.full(len(words), -1.0)
        for n, (at, rows) in by_length(words).items():
            places = np.array(at)
            for s in range(0, places.size, STEP):
                f, w = features(rows[s : s + STEP])
                raw = self.weight[f] @ w.astype(np.float32)
                least = np.sqrt((triples(n)[3] ** 2).sum())
                value = raw / least + self.bias  # no smaller norm is possible
                close = np.flatnonzero(value > -0.5)
                if close.size:
                    value[close] = raw[close] / np.sqrt(squared_norms(f[close], w)) + self.bias
                np.maximum.at(out, places[s : s + STEP], value)
        return out

    def document_features(self, texts: list[str], step: int = 64) -> np.ndarray:
        """Hits, their share of the words, and the largest margin of each text."""
        return np.concatenate([self._features(texts[k : k + step]) for k in range(0, len(texts), step)] or [np.zeros((0, 3))])

    def _features(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = list({w for words in split for w in words})
        plain = [bare(w) for w in new]
        self.memo.update(zip(new, self.margins(plain).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        low = min(0.25, max(-0.5, self.bias + 0.25))  # a word like no landmark is no hit
        for k, words in enumerate(split):
            if words:
                m = np.array([self.memo[w] for w in words])
                hits = np.clip((m - low) / (0.5 - low), 0, 1).sum()
                out[k] = hits, hits / len(words), max(m.max() - low, 0.0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-design(self.document_features(texts)) @ self.calibration))


def design(x: np.ndarray) -> np.ndarray:
    hits, share, top = x.T
    return np.stack([np.ones_like(hits), np.log1p(hits), np.minimum(100 * share, 4), np.minimum(top, 2), np.minimum(hits, 1)], 1)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate ascent; a constant feature is the bias."""
    x = np.concatenate([x, np.ones((x.shape[0], 1), x.dtype)], 1)
    alpha, w, q = np.zeros(y.size), np.zeros(x.shape[1]), (x**2).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(y.size):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit_calibration(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly regularised; the slopes stay positive or 0."""
    used = np.arange(x.shape[1])
    while True:
        b = np.zeros(used.size)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, used] @ b, -30, 30)))
            g = x[:, used].T @ (p - y) + 1e-2 * b
            h = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + 1e-2 * np.eye(used.size)
            b -= np.linalg.solve(h, g)
        keep = (b > 0) | (used == 0)
        if keep.all():
            out = np.zeros(x.shape[1])
            out[used] = b
            return out
        used = used[keep]


def profile(text: str) -> tuple[list[list[str]], list[int]]:
    """What training keeps of a text: its sentences' distinct words (none that stood in a sentence
    before), and the least hashes of its word pairs."""
    sentences, seen = [], set()
    words = words_of(text)
    for part in sentences_of(text):
        own = {w for w in map(bare, part) if len(w) > 1} - seen
        seen |= own
        if own:
            sentences.append(sorted(own))
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or seen
    return sentences, heapq.nsmallest(SIGNATURE, (zlib.crc32(w.encode()) for w in pairs))


def train(samples: list[tuple[int, str]], landmarks: int = LANDMARKS) -> Machine | None:
    """``samples``: label and text of documents."""
    profiles = ((label, *profile(text)) for label, text in samples)
    return fit(profiles, lambda machine: (machine.document_features([s[1] for s in samples]), np.array([s[0] for s in samples], np.float64)), landmarks)


def fit(profiles: Iterable[tuple[int, list[list[str]], list[int]]], measure: Callable[[Machine], tuple[np.ndarray, np.ndarray]], landmarks: int = LANDMARKS) -> Machine | None:
    """``profiles``: label and ``profile`` of documents, read once; ``measure`` gives the features of
    the same documents under a machine, and their labels."""
    number: dict[str, int] = {}
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # word numbers: of other documents, of toxic sentences
    total = [0, 0]
    # near copies count once: a document that shares most of its least word pairs' hashes with one before
    group_of: dict[tuple[int, int], int] = {}
    for at, (label, sentences, least) in enumerate(profiles):
        known = Counter(group_of[label, h] for h in least if (label, h) in group_of).most_common(1)
        copy = bool(known) and 2 * known[0][1] >= len(least)
        for h in least:
            group_of[label, h] = known[0][0] if copy else at
        if copy:
            continue
        total[label] += 1
        held[label].extend(np.array([number.setdefault(w, len(number)) for w in words], np.int32) for words in sentences)
    del group_of
    if not all(total):
        return None
    words = list(number)
    # a word is in one sentence of a document at most, so these are numbers of documents
    count = [np.bincount(np.concatenate([*x, np.zeros(0, np.int32)]), minlength=len(words)) for x in held]
    ratio = (count[1] / total[1]) / ((count[0] + 0.5) / total[0])
    enough = (count[1] >= max(MIN_DOCS, MIN_SHARE * total[1])) & (ratio >= MIN_RATIO)
    toxic = held[1]
    size = np.array([x.size for x in toxic])
    starts, flat = np.cumsum(size) - size, np.concatenate([*toxic, np.zeros(0, np.int32)])

    def witnesses(evidence: np.ndarray) -> np.ndarray:
        """Number of toxic sentences that each word is the witness of: the one of most evidence, if
        that is over 0."""
        value = evidence[flat]
        best = np.maximum.reduceat(value, starts)
        own = (value == np.repeat(best, size)) & (value > 0)
        first = np.flatnonzero(own)
        _, one = np.unique(np.repeat(np.arange(size.size), size)[first], return_index=True)
        return np.bincount(flat[first[one]], minlength=len(words))

    if not flat.size:
        return None
    weight = witnesses(np.where(enough, count[1] * np.log(np.maximum(ratio, 1e-9)), 0))
    strong = np.argsort(-weight, kind="stable")[: np.count_nonzero(weight)]
    calm = np.flatnonzero((count[0] > 0) & (ratio < 2) & (weight == 0))
    usual = calm[np.argsort(-count[0][calm], kind="stable")][: landmarks // 2]
    if not strong.size or not usual.size:
        return None
    marks = Landmarks([words[i] for i in [*strong[: landmarks // 2], *usual]])
    values, vectors = np.linalg.eigh((marks.own @ marks.own.T).astype(np.float64))
    good = values > 1e-5
    root = vectors[:, good] / np.sqrt(values[good])
    plain, spelled, machine = usual, [words[i] for i in calm], None
    for k in range(ROUNDS):
        examples = np.concatenate([strong, plain])
        x = marks.kernel([words[i] for i in examples]).astype(np.float64) @ root
        x = np.concatenate([x, np.zeros((1, x.shape[1]))])  # a word like no landmark is a negative example
        y = np.concatenate([np.ones(strong.size), -np.ones(plain.size + 1)])
        cost = np.concatenate([10 * np.minimum(1, weight[strong] / 20), 10 * np.minimum(1, (4 + count[0][plain]) / 20), [1000.0]])
        w, bias = fit_machine(x, y, cost, 30)
        folded = np.zeros(ALPHABET**3)
        folded[marks.triples] = (root @ w) @ marks.own
        machine = Machine(folded, bias, np.zeros(5))
        if k + 1 == ROUNDS:
            break
        # witnesses by margin, of words that speak for the label at all
        margin = np.full(len(words), -1.0)
        some = np.flatnonzero((count[1] > 0) & (ratio >= 2))
        margin[some] = machine.margins([words[i] for i in some])
        weight = np.maximum(witnesses(margin), np.where(enough, weight, 0))
        strong = np.flatnonzero(weight)
        # words of other documents that the machine came near to
        margin = machine.margins(spelled)
        near = calm[np.argsort(-margin, kind="stable")[: np.count_nonzero(margin > -0.9)]]
        plain = np.concatenate([plain, near[~np.isin(near, plain)][:HARD]])
    x, labels = measure(machine)
    machine.calibration = fit_calibration(design(x), labels)
    machine.memo = {}
    return machine


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Labelled texts for training, whole: the documents of at most ``per_class`` ids of either
    label, by hash of the id, of those not held out; one row for each id and text."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [ids.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class ids at most
    return docs.filter(F.col("text").isNotNull()).join(chosen, "doc_id").select("doc_id", "toxic", "text").distinct().withColumn("text_key", F.xxhash64("text"))


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from labelled documents. Texts stay on the executors; the driver reads their
    profiles a partition at a time and keeps word counts, then three features of each."""
    spark = docs.sparkSession
    rows = common.keep(sample(docs, labels))

    def profiles(batches):
        for batch in batches:
            raw, at = common.raw_texts(batch.column(batch.schema.names.index("text")))
            for i, j in common.groups(at):
                own, least = zip(*(profile(raw[at[k] : at[k + 1]].tobytes().decode()) for k in range(i, j)), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).slice(i, j - i) for c in ("doc_id", "text_key", "toxic")), pa.array(own, pa.list_(pa.list_(pa.string()))), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "text_key", "toxic", "own", "least"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "text_key", "toxic"))
    found = common.keep(rows.mapInArrow(profiles, f"{kinds}, own array<array<string>>, least array<bigint>")).orderBy("doc_id", "text_key")

    def measure(machine: Machine) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(machine)  # 1 MB, whatever the input

        def run(batches):
            for batch in batches:
                raw, at = common.raw_texts(batch.column(batch.schema.names.index("text")))
                x = np.zeros((batch.num_rows, 3))
                for i, j in common.groups(at):
                    x[i:j] = shared.value.document_features([raw[at[k] : at[k + 1]].tobytes().decode() for k in range(i, j)])
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text_key", "toxic")), *(pa.array(c) for c in x.T)], ["doc_id", "text_key", "toxic", "hits", "share", "top"])

        got = rows.mapInArrow(run, f"{kinds}, hits double, share double, top double").orderBy("doc_id", "text_key").select("toxic", "hits", "share", "top").collect()
        return np.array([r[1:] for r in got], np.float64).reshape(-1, 3), np.array([r[0] for r in got], np.float64)

    return fit(((r.toxic, r.own, r.least) for r in found.toLocalIterator()), measure)


def score_texts(df: DataFrame, machine: Machine | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, 0 to 1; it replaces an input column of that name."""
    if machine is None:
        return df.withColumn(out, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(machine)  # 1 MB, whatever the input
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).withColumn(out, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            raw, at = common.raw_texts(batch.column(batch.schema.names.index(text)))
            score = np.zeros(batch.num_rows)
            for i, j in common.groups(at):
                score[i:j] = shared.value.scores([raw[at[k] : at[k + 1]].tobytes().decode() for k in range(i, j)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(score)], [*names, out])

    return df.mapInArrow(run, schema)


def learned(spark: SparkSession, sf_dir: str) -> Machine | None:
    return learn(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, learned(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
