"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
estimates how each votes on either kind, from the counts of vote patterns over all documents (there
are at most 3 ** labellers patterns, whatever the data), and gives each pattern the probability
of being good. These posteriors are the soft labels of a hashed linear scorer over word and
shape features, which never sees the votes; it is fitted on a bounded sample of documents and then
scores every one. Each text is read once: its pattern and its hashed features are written, and
everything after that works on these.

Defined results: null and empty texts are scored and have no votes but the length one; texts of
any length are read whole; where all votes agree the prior decides; ties of the sample's order go by
id; of rows that repeat an id one is learnt from and each is scored; a null doc_id is carried along
and not learnt from; an empty table gives an empty result; other columns are never read, so their
names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import WordHashes, id_text, lean, staged
from tabulith.llm.extraction import STOP

BUCKETS = 1 << 16
#: The scorer is fitted on at most so many documents, those of the smallest hash of the id. A document has
#: at most BUCKETS features, of 6 bytes, which bounds what comes to the driver.
MAX_SAMPLE = 6000
KEEP = 0.5
SYMBOLS = re.compile(r"[#%&$*|@^~<>=\\{}]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LOWER = re.compile(r"[a-zß-öø-ÿ]")
EDGES = ".,;:!?\"'()[]{}#%&$*|"
LABELLERS = ("stop_words", "symbols", "case", "distinct", "top_word", "length", "lines", "word_length", "shouting", "sentence_ends")


def votes(text: str) -> tuple[int, ...]:
    """One vote a labeller: 1 good, -1 bad, 0 none."""
    words = text.split()
    n = len(words)

    def judge(value: float, good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    if not n:
        return (0, 0, 0, 0, 0, -1, 0, 0, 0, 0)
    count = Counter(words)
    stop = sum(c for w, c in count.items() if w.lower().strip(EDGES) in STOP) / n
    symbols = len(SYMBOLS.findall(text)) / n
    up, low = len(UPPER.findall(text)), len(LOWER.findall(text))
    upper = up / (up + low) if up + low else 0.0
    distinct, top = len(count) / n, count.most_common(1)[0][1] / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    mean = sum(map(len, words)) / n
    shouts = text.count("!!") / n
    ends = sum(x.rstrip()[-1] in ".!?:" for x in lines) / len(lines)
    return (
        judge(stop, stop >= 0.15, stop < 0.05),
        judge(symbols, symbols < 0.02, symbols > 0.25),
        judge(upper, upper < 0.2, upper > 0.6),
        0 if n < 50 else judge(distinct, distinct > 0.35, distinct < 0.15),
        0 if n < 20 else judge(top, top < 0.12, top > 0.25),
        judge(n, n >= 30, n < 4),
        0 if len(lines) < 3 else judge(repeated, repeated < 0.1, repeated > 0.3),
        judge(mean, 3 <= mean <= 11, mean < 2 or mean > 20),
        judge(shouts, False, shouts > 0.3),
        judge(ends, ends > 0.6, ends < 0.1),
    )


def code(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def decode(c: int, k: int = len(LABELLERS)) -> list[int]:
    out = []
    for _ in range(k):
        c, r = divmod(c, 3)
        out.append(r - 1)
    return out[::-1]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """How often each labeller votes bad, nothing or good on bad and on good documents (2 x labellers x 3),
    the share of good ones, and each pattern's posterior. That a labeller keeps silent tells something too:
    one that only ever says bad is silent on good documents."""
    k = patterns.shape[1]
    # Pseudo-counts keep a labeller that never votes, or always the same way, from certainty, and say which way is good.
    lean = np.array([[4, 1, 1], [1, 1, 4]], float)
    if not len(counts):
        return np.repeat((lean / 6)[:, None], k, 1), 0.5, np.empty(0)
    voted = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    against = (patterns < 0).sum(1)
    post = np.where(against > 1, 0.1, np.where(against > 0, 0.4, 0.95))
    for _ in range(rounds):
        rates = np.stack([np.einsum("p,pkv->kv", counts * w, voted) + a for w, a in zip((1 - post, post), lean, strict=True)])
        rates /= rates.sum(2, keepdims=True)
        prior = float((counts * post).sum() + 5) / (counts.sum() + 10)
        bad, good = np.einsum("pkv,ckv->cp", voted, np.log(rates))
        post = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + bad - np.log(prior) - good, -30, 30)))
    return rates, prior, post


SHAPES = [(b"%", 1), (b"#", 2), (b"&", 3), (b"$", 4), (b"*", 5), (b"|", 6), (b"!!", 7)]


def features(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket ids and values: the share of each distinct word, how much words repeat, and their shapes."""
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    if not n:
        return np.array([8], np.uint16), np.ones(1, np.float32)
    count = Counter(raw)
    ids = np.fromiter((hashes[w] for w in count), np.uint64, len(count)) % np.uint64(BUCKETS - 64) + np.uint64(64)
    value = np.fromiter(count.values(), np.float32, len(count)) / n
    joined = b" ".join(raw)
    shape = np.array([min(1.0, joined.count(s) / n) for s, _ in SHAPES], np.float32)
    upper = sum(w.isupper() for w in count) / len(count)
    mean = sum(len(w) * c for w, c in count.items()) / n
    plain = sum(c for w, c in count.items() if w.isalpha()) / n
    extra = 2 * np.array([*shape, 1.0 - len(count) / n, upper, value.max(), min(1.0, n / 50), min(1.0, mean / 20), plain, 1.0], np.float32)
    where = np.array([*(k for _, k in SHAPES), 9, 10, 11, 12, 13, 14, 15])
    ids, back = np.unique(ids, return_inverse=True)
    value = np.sqrt(np.bincount(back, value))
    return np.concatenate([where, ids.astype(np.int64)]).astype(np.uint16), np.concatenate([extra, value]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad."""
    w, g2 = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-2, np.float32)
    b, b2 = 0.0, 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, x = rows[k]
            z = float(w[ids] @ x) + b
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[k]
            g = e * x + 1e-5 * w[ids]
            g2[ids] += g * g
            w[ids] -= rate * g / np.sqrt(g2[ids])
            b2 += e * e
            b -= rate * e / np.sqrt(b2)
    return w, b


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vote pattern and the features of each document."""
    hashes = WordHashes()
    for batch in batches:
        ps, ids, xs = [], [], []
        for t in batch.column(1).to_pylist():
            i, x = features(t, hashes)
            ps.append(code(votes(t)))
            ids.append(i.tobytes())
            xs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ps, pa.int64()), pa.array(ids, pa.binary()), pa.array(xs, pa.binary())], names=["doc_id", "pattern", "ids", "x"])


def unpacked(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.uint16).astype(np.int64), np.frombuffer(x, np.float32)


def label_model(stage: DataFrame) -> tuple[dict[int, float], float]:
    """The posterior of each vote pattern, and the prior."""
    seen = {r["pattern"]: r["count"] for r in stage.groupBy("pattern").count().collect()}
    keys = sorted(seen)  # at most 3 ** labellers
    patterns = np.array([decode(k) for k in keys]).reshape(-1, len(LABELLERS))
    _, prior, post = expectation_maximisation(patterns, np.array([seen[k] for k in keys], float))
    return dict(zip(keys, post.tolist(), strict=True)), prior


def classify(spark: SparkSession, documents: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, posterior, score and keep of every document."""
    rows = id_text(documents).select(F.col("doc_id").cast("long"), "text")
    stage = staged(spark, rows.mapInArrow(lean(described), "doc_id long, pattern long, ids binary, x binary"), "quality")
    posterior, prior = label_model(stage)

    chosen = stage.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    sample = stage.join(F.broadcast(chosen), "doc_id")  # at most max_sample ids
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("pattern", "ids", "x")).alias("r"))
    got = sorted((r[0], r[1]["pattern"], bytes(r[1]["ids"]), bytes(r[1]["x"])) for r in sample.collect())
    w, b = fit([unpacked(r[2], r[3]) for r in got], np.array([posterior[r[1]] for r in got]))
    held = spark.sparkContext.broadcast((w, b, posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, known = held.value
        for batch in batches:
            ps = [known.get(p, prior) for p in batch.column(1).to_pylist()]
            z = [float(weight[i] @ x) + bias for i, x in (unpacked(i.as_py(), x.as_py()) for i, x in zip(batch.column(2), batch.column(3), strict=True))]
            ss = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ps, pa.float64()), pa.array(ss, pa.float64())], names=["doc_id", "posterior", "score"])

    return stage.mapInArrow(lean(score), "doc_id long, posterior double, score double").withColumn("keep", F.col("score") >= KEEP)
