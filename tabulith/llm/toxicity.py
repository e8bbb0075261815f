"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is represented by the hashed character n-grams of its marked form (<word>), so that an
unseen misspelling or inflection shares most of its vectors with words seen in training. A text
is the weighted average of the vectors of its distinct n-grams; a linear softmax over that
average gives the score, and embeddings and softmax are fitted together by Adam.

Since the softmax is linear, a bucket contributes one number to the logit once the model is
fitted: the broadcast model is two float arrays of `BUCKETS` entries, whatever the data.

Defined results: null and empty texts score as the model's bias; texts of any length are scored
whole; labels that are null are not learnt from, and of contradicting labels of a document the
larger counts; of rows that repeat an id, and of texts that are copies or near copies of each other,
one is learnt from, that of the smallest id; ties of the sample's order go by id; no labels at all
(or one class only) give the base rate as every score; a null doc_id is scored and counts as not held
out; repeated rows each give a row; empty tables give an empty result; other columns of documents and
labels are never read, so their names cannot clash, and drop_toxic hands them on as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import WordHashes, id_text, lean, mix64, shingles, staged, words_of

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5, 6)
#: At most so many labelled documents of class 0 and 1 are learnt from, those of the smallest hash.
MAX_PER_CLASS = (6000, 3000)
#: So many buckets at most have a weight: those that tell most.
MOST_BUCKETS = 6000
THRESHOLD = 0.7
#: Buckets whose log-likelihood ratio with the label is below this say nothing and weigh nothing.
LEAST_RATIO = 12.0
#: Buckets in fewer of the distinct texts learnt from are left out.
LEAST_TEXTS = 3
#: What is added to the sum of weights that a text's average is divided by.
SMOOTH = 8.0
WORD = re.compile(r"[^\W\d_]+")


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the character n-grams of marked words and of the words themselves, and whose they are.

    n-grams are hashed all at once: a polynomial over code points, scrambled.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))  # code points to the word's end
    h, ids, who = codes.copy(), [], []
    for k in range(2, max(GRAMS) + 1):
        h = h[: len(codes) - k + 1] * np.uint64(0x100000001B3) + codes[k - 1 :]
        if k in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= k)
            ids.append(mix64(h[at] + np.uint64(k)))
            who.append(owner[at])
    import xxhash

    ids.append(np.array([xxhash.xxh3_64_intdigest(m.encode("utf-8", "surrogatepass")) for m in marked], np.uint64))
    who.append(np.arange(len(words)))
    return (np.concatenate(ids) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(who)


def text_buckets(text: str) -> np.ndarray:
    """The buckets of the distinct words of a text, with repeats."""
    return word_buckets(sorted(set(WORD.findall(text.lower()))))[0]


class SubwordModel:
    """weight: what a bucket adds to the logit; share: its weight in the average."""

    def __init__(self, weight: np.ndarray, share: np.ndarray, bias: float, scale: float):
        self.weight, self.share, self.bias, self.scale = weight, share, bias, scale

    def score(self, buckets: np.ndarray) -> float:
        s = self.share[buckets]
        return self.of_sums(float((self.weight[buckets] * s).sum()), float(s.sum()))

    def of_sums(self, top: float, low: float) -> float:
        z = self.bias + self.scale * top / (low + SMOOTH)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


class WordSums(dict):
    """Word -> what it adds to both sums of a text's average, None if nothing; forgets when large."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.share, self.weighted = model.share, model.share * model.weight

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > 600_000:
            self.clear()
        new = [w for w in words if w not in self]
        ids, who = word_buckets(new)
        told = self.share[ids] > 0
        ids, who = ids[told], who[told]
        top, low = np.bincount(who, self.weighted[ids], len(new)), np.bincount(who, self.share[ids], len(new))
        self.update(dict.fromkeys(new))
        for k in np.flatnonzero(low):
            self[new[k]] = (float(top[k]), float(low[k]))


def informativeness(pos_df: np.ndarray, all_df: np.ndarray, pos: int, n: int) -> np.ndarray:
    """Supervised term weight of each bucket: the root of its log-likelihood ratio with the label, or 0.

    Averaging with these weights keeps a few telling words from drowning in a long text.
    """
    a, seen = pos_df.astype(np.float64), all_df.astype(np.float64)
    g = np.zeros(BUCKETS)
    for got, rows, cols in ((a, pos, seen), (seen - a, n - pos, seen), (pos - a, pos, n - seen), (n - pos - seen + a, n - pos, n - seen)):
        want = rows * cols / max(n, 1)
        g += np.where(got > 0, 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(want, 1e-9)), 0)
    g[(g < LEAST_RATIO) | (seen < LEAST_TEXTS)] = 0
    if (g > 0).sum() > MOST_BUCKETS:
        g[g < np.partition(g, -MOST_BUCKETS)[-MOST_BUCKETS]] = 0
    return np.sqrt(g).astype(np.float32)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: np.ndarray, epochs: int = 10, seed: int = 7, rate: float = 0.02, decay: float = 1e-5) -> SubwordModel:
    """Trains embeddings and softmax together; docs hold distinct buckets of positive share, and how often each occurs."""
    n, y = len(docs), labels.astype(np.float32)
    pos = float(y.sum())
    prior = np.log((pos + 0.5) / (n - pos + 0.5))
    zero = np.zeros(BUCKETS, np.float32)
    if not n or pos in (0, n):
        return SubwordModel(zero, zero, float(prior), 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    m1, m2 = np.zeros_like(emb), np.zeros_like(emb)
    s1, s2, b1, b2 = np.zeros_like(soft), np.zeros_like(soft), np.zeros_like(bias), np.zeros_like(bias)
    scale, step, size = 4.0, 0, 32
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, size):
            rows = order[at : at + size]
            lens = np.array([len(docs[r][0]) for r in rows])
            ids = np.concatenate([docs[r][0] for r in rows])
            owner = np.repeat(np.arange(len(rows)), lens)
            w = share[ids] * np.concatenate([docs[r][1] for r in rows])
            total = np.bincount(owner, w, len(rows)).astype(np.float32)
            w = scale * w / (total + SMOOTH)[owner]
            used, back = np.unique(ids, return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            np.add.at(x, (owner, back), w)
            e = emb[used]
            h = x @ e
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(rows)), y[rows].astype(int)] -= 1
            g /= len(rows)
            ge, gs, gb = x.T @ (g @ soft.T) + decay * e, h.T @ g + 1e-4 * soft, g.sum(0)
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            m1[used] = 0.9 * m1[used] + 0.1 * ge
            m2[used] = 0.999 * m2[used] + 0.001 * ge * ge
            emb[used] -= rate * (m1[used] / fix1) / (np.sqrt(m2[used] / fix2) + 1e-8)
            for par, a, b, gr in ((soft, s1, s2, gs), (bias, b1, b2, gb)):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                par -= rate * (a / fix1) / (np.sqrt(b / fix2) + 1e-8)
    weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return SubwordModel(weight, share, float(bias[1] - bias[0]), scale)


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that are not held out, one row each."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def training_rows(spark: SparkSession, documents: DataFrame, lab: DataFrame, max_per_class: tuple[int, int]) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents, at most max_per_class of class 0 and 1."""
    pick = [lab.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class[c]) for c in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most sum(max_per_class) rows
    rows = id_text(documents).join(chosen, "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(words_of(t), hashes) for t in b.column(1).to_pylist()]
            least = pa.array([int(x[0] >> np.uint64(1)) if len(x) else -1 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, least], names=["doc_id", "text", "toxic", "least"])

    # Near copies mostly share their smallest shingle; each pair of label and shingle is learnt from once.
    rows = rows.mapInArrow(lean(near), "doc_id long, text string, toxic int, least long")
    rows = rows.groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return staged(spark, rows.select("r.doc_id", "r.text", "toxic").repartition(16, "doc_id"), "labelled")


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies of all buckets, over toxic texts and over all."""
    df = np.zeros((2, BUCKETS), np.int32)
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.unique(text_buckets(text))
            df[1, ids] += 1
            if toxic:
                df[0, ids] += 1
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], names=["df"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_per_class: tuple[int, int] = MAX_PER_CLASS) -> SubwordModel:
    """Fits on the sample, then moves the bias to the odds that the labels have as a whole."""
    lab = usable_labels(labels)
    every = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    rows = training_rows(spark, documents, lab, max_per_class)
    df = np.zeros((2, BUCKETS), np.int64)
    for r in rows.select("text", "toxic").mapInArrow(lean(frequencies), "df binary").collect():
        df += np.frombuffer(zlib.decompress(bytes(r[0])), np.int32).reshape(2, BUCKETS)
    size = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = informativeness(df[0], df[1], size[1], size[0])
    held = spark.sparkContext.broadcast(share)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in b.column(1).to_pylist():
                ids, times = np.unique(text_buckets(t), return_counts=True)
                told = held.value[ids] > 0  # at most MOST_BUCKETS
                packed.append(np.stack([ids[told], times[told]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), b.column(2)], names=["doc_id", "buckets", "toxic"])

    got = sorted(((r[0], r[2], bytes(r[1])) for r in rows.mapInArrow(lean(told), "doc_id long, buckets binary, toxic int").collect()))
    y = np.array([r[1] for r in got], np.float32)
    model = fit([tuple(np.frombuffer(r[2], np.int32).reshape(2, -1)) for r in got], y, share)
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if pos and neg:
        model.bias += float(np.log(every.get(1, 1) / every.get(0, 1)) - np.log(pos / neg))
    return model


def scorer(spark: SparkSession, model: SubwordModel):
    """A function for mapInArrow tasks: texts -> scores, model.score(text_buckets(text)) up to rounding."""
    held = spark.sparkContext.broadcast((model.weight, model.share, model.bias, model.scale))

    def make():
        model = SubwordModel(*held.value)
        sums, find = WordSums(model), WORD.findall

        def some(texts: list[str | None]) -> list[float]:
            words = [set(find(t.lower())) if t else set() for t in texts]
            sums.learn(set().union(*words))
            out = []
            for w in words:
                got = sorted(x for x in map(sums.__getitem__, w) if x)  # the same sum whatever the order of the set
                out.append(model.of_sums(sum(x[0] for x in got), sum(x[1] for x in got)))
            return out

        def score(texts: list[str | None]) -> list[float]:
            return [x for k in range(0, len(texts), 400) for x in some(texts[k : k + 400])]

        return score

    return make


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_per_class: tuple[int, int] = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    make = scorer(spark, train(spark, documents, labels, max_per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            s = pa.array(score(b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s], names=["doc_id", "score"])

    rows = id_text(documents).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lean(run), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_per_class: tuple[int, int] = MAX_PER_CLASS) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    make, at = scorer(spark, train(spark, documents, labels, max_per_class)), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            yield b.filter(pa.array([s < THRESHOLD for s in score(b.column(at).to_pylist())], pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)
