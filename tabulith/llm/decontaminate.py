"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap verification.

The items are indexed (long ones in parts of at most `PART` words); every training passage, a
window of `PASSAGE` words that begins every `STRIDE` words, is a query, and every part whose
score reaches `THRESHOLD` of its score against itself is retrieved. As in block-max WAND, parts
lie in blocks, each term keeps its largest impact per block, and a block is entered only where the
summed maxima of the passage's terms reach the threshold; since the threshold is fixed, the pivots
of a slice of passages are found at once, from the pairs of passage and block that have a term in
common. Within a block only the postings of that block are scored. Terms of many blocks are left out
of the bounds as far as they make up at most half the threshold in every part, so a text without
any other term matches nothing.
A hit counts if both halves of the item, question and answer, overlap with the words around it.

The index is broadcast in shards of at most `SHARD_BYTES` of item text, one at a time; beyond one
shard the documents are scanned once for each. Part counts, lengths and document frequencies are
those of all items, so scores do not depend on the shards.

Defined results: items without a word are left out; null and empty documents match nothing; an
item given twice is reported under each id; several hits of a document and item give one row,
the best, and of equally good ones the first; repeated documents each give rows; texts of any length
are looked through whole, a slice of passages at a time; empty tables give an empty result; other
columns of either table are never read by the search, so their names cannot clash, and drop_leaks
hands them on as they are.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import id_text, lean, staged

PASSAGE, STRIDE, PART, BLOCK = 128, 64, 64, 4
THRESHOLD = 0.5
#: Share of the blocks from which a term counts as common.
COMMON = 0.1
OVERLAP, GRAM = 0.6, 3
K1, B = 1.2, 0.75
SHARD_BYTES = 32 << 20
#: A-Z lowered and ASCII punctuation made space, on both sides.
CLEAN = bytes(32 if chr(c) in string.punctuation else c for c in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(CLEAN).split()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: cut at the first line break or question mark that leaves words on both sides, else in the middle."""
    for mark in ("\n", "?"):
        head, _, tail = text.partition(mark)
        q, a = words(head), words(tail)
        if len(q) >= GRAM and len(a) >= GRAM:
            return q, a
    w = words(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def grams(w: list[bytes]) -> set:
    k = min(GRAM, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def overlap(part: list[bytes], around: list[bytes]) -> float:
    want = grams(part)
    if not want:
        return 1.0
    k = min(GRAM, len(part))
    have = {tuple(around[i : i + k]) for i in range(len(around) - k + 1)}
    return len(want & have) / len(want)


def cut(w: list[bytes]) -> list[list[bytes]]:
    """An item's words in parts of at most PART."""
    n = -(-len(w) // PART)
    return [w[j * len(w) // n : (j + 1) * len(w) // n] for j in range(n)]


class Index:
    """BM25 impacts of item parts, as shares of a part's score against itself, with block maxima.

    `known` has the number of parts, of their words, and the parts that hold each word, of all
    items where `items` are a shard of them.
    """

    def __init__(self, items: list[tuple[int, str]], known: tuple[int, int, dict[bytes, int]] | None = None):
        self.items = [(i, t) for i, t in items if words(t)]
        self.halves = [halves(t) for _, t in self.items]
        parts: list[tuple[int, list[bytes]]] = []
        for k, (_, t) in enumerate(self.items):
            parts += [(k, w) for w in cut(words(t))]
        self.parts = parts
        df: dict[bytes, int] = defaultdict(int)
        for _, w in parts:
            for x in set(w):
                df[x] += 1
        self.ids = {w: k for k, w in enumerate(sorted(df))}
        total, length, df = known or (len(parts), sum(len(w) for _, w in parts), df)
        mean = length / max(1, total)
        lists: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for p, (_, w) in enumerate(parts):
            tf: dict[bytes, int] = defaultdict(int)
            for x in w:
                tf[x] += 1
            got = {x: np.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for x, c in tf.items()}
            own = sum(got.values())
            for x, v in got.items():
                lists[self.ids[x]].append((p, v / own))
        self.starts = np.cumsum([0, *map(len, lists)])
        self.part = np.array([p for plist in lists for p, _ in plist], np.int64)
        self.impact = np.array([v for plist in lists for _, v in plist], np.float64)
        self.blocks = -(-len(parts) // BLOCK) if parts else 0
        at, block, most = [0], [], []
        inside: list[list[tuple[int, int, float]]] = [[] for _ in range(self.blocks)]
        for k, plist in enumerate(lists):
            top: dict[int, float] = {}
            for p, v in plist:
                top[p // BLOCK] = max(top.get(p // BLOCK, 0.0), v)
                inside[p // BLOCK].append((k, p % BLOCK, v))
            block += top.keys()
            most += top.values()
            at.append(len(block))
        self.at, self.block, self.most = np.array(at), np.array(block, np.int64), np.array(most, np.float64)
        # The postings of each block, by term.
        self.inside = [tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int64, np.float64))) for rows in inside]
        # Terms of many blocks are not looked up for bounds: what they can add to a part is taken off the threshold.
        # They take off half of it at most, the longest lists first; the others are looked up all the same.
        size = np.diff(self.at)
        common = size > max(1, self.blocks * COMMON)
        rest = np.zeros(self.blocks * BLOCK)
        for k in sorted(np.flatnonzero(common).tolist(), key=lambda k: (-size[k], k)):
            p, v = self.of(k)
            if (rest[p] + v).max() <= THRESHOLD / 2:
                rest[p] += v
            else:
                common[k] = False
        self.rare = np.r_[~common, False]
        self.need = THRESHOLD - 1e-9 - (rest.reshape(self.blocks, BLOCK).max(1) if self.blocks else rest)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts that hold term k, and its impacts there."""
        at = slice(self.starts[k], self.starts[k + 1])
        return self.part[at], self.impact[at]

    def scores(self, block: int, present: np.ndarray) -> np.ndarray:
        """The score of a block's parts against the terms marked in `present`."""
        term, part, impact = self.inside[block]
        found = present[term]
        return np.bincount(part[found], impact[found], BLOCK)


#: Passages whose bounds are held at once.
SLICE = 512


class Matcher:
    def __init__(self, index: Index):
        self.x = index

    def match(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage), best per item."""
        x = self.x
        if not text or not x.blocks:
            return []
        raw = words(text)
        n = len(raw)
        term = np.fromiter(map(x.ids.get, raw, repeat(-1)), np.int64, n)
        always = np.flatnonzero(x.need <= 0)  # blocks that common terms alone may fill
        if not x.rare[term].any() and not len(always):  # term -1 reads the last entry, which is false
            return []
        passages = -(-(n - PASSAGE) // STRIDE) + 1 if n > PASSAGE else 1
        found: dict[int, tuple] = {}
        present = np.zeros(len(x.ids) + 1, bool)
        for first in range(0, passages, SLICE):
            some = min(SLICE, passages - first)
            last, pivots = -1, self.pivots(term[first * STRIDE : (first + some - 1) * STRIDE + PASSAGE], some, always)
            for p, block in pivots:
                p += first
                if p != last:
                    mine = term[p * STRIDE : p * STRIDE + PASSAGE]
                    present[:] = False
                    present[mine] = True
                    present[-1] = False
                    last = p
                score = x.scores(block, present)
                for part in np.flatnonzero(score >= THRESHOLD).tolist():
                    item, s = x.parts[block * BLOCK + part][0], float(score[part])
                    if item in found and found[item][1] >= round(s, 6):
                        continue
                    q, ans = x.halves[item]
                    reach = len(q) + len(ans)
                    around = raw[max(0, p * STRIDE - reach) : p * STRIDE + PASSAGE + reach]
                    oq, oa = overlap(q, around), overlap(ans, around)
                    if oq >= OVERLAP and oa >= OVERLAP:
                        found[item] = (x.items[item][0], round(s, 6), oq, oa, p * STRIDE)
        return sorted(found.values(), key=lambda r: (r[0] is None, r[0], r[4]))


    def pivots(self, term: np.ndarray, passages: int, always: np.ndarray) -> list[tuple[int, int]]:
        """The (passage, block) pairs of a slice of terms whose bound reaches what the block needs, in order."""
        x = self.x
        pos = np.flatnonzero(x.rare[term])
        first = np.maximum(0, (pos - PASSAGE) // STRIDE + 1)
        span = np.minimum(passages - 1, pos // STRIDE) - first + 1  # passages a word lies in
        who = np.repeat(np.arange(len(pos)), span)
        passage = first[who] + (np.arange(len(who)) - np.repeat(np.cumsum(span) - span, span))
        pair = np.unique(passage * len(x.ids) + term[pos][who])  # a term counts once in a passage
        passage, t = pair // len(x.ids), pair % len(x.ids)
        lens = x.at[t + 1] - x.at[t]
        rep = np.repeat(np.arange(len(t)), lens)
        entry = x.at[t][rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(lens) - lens, lens))
        met, back = np.unique(passage[rep] * x.blocks + x.block[entry], return_inverse=True)
        bound = np.bincount(back, x.most[entry], len(met))
        reached = met[bound >= x.need[met % x.blocks]]
        if len(always):
            reached = np.union1d(reached, (np.arange(passages)[:, None] * x.blocks + always).ravel())
        return [divmod(k, x.blocks) for k in reached.tolist()]


def word_counts(items: DataFrame) -> DataFrame:
    """(word, parts, length): the parts that hold each word; of no word, the number of parts and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [p for t in b.column(0) for p in cut(words(t.as_py()))]
            df = Counter(x for p in parts for x in set(p))
            cols = [pa.array([None, *df], pa.binary()), pa.array([len(parts), *df.values()], pa.int64()), pa.array([sum(map(len, parts)), *[0] * len(df)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "parts", "length"])

    made = items.select("text").mapInArrow(lean(run), "word binary, parts long, length long")
    return made.groupBy("word").agg(F.sum("parts").alias("parts"), F.sum("length").alias("length"))


def shards(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcast indexes over items of at most SHARD_BYTES each, and whether there is one only."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // SHARD_BYTES)
    if n > 1:
        counts = staged(spark, word_counts(items), "item-words")
        total, length = counts.where("word IS NULL").select("parts", "length").first()
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = own.collect()
        known = None
        if n > 1:  # of all words, only those of the shard come to the driver
            known = total, length, {bytes(r[0]): r[1] for r in counts.join(word_counts(own).select("word"), "word").select("word", "parts").collect()}
        yield spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1])), known)), n == 1


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_start long"


def find_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it leaks."""

    def over(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(index.value)
            for b in batches:
                rows = [(d, *r) for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in m.match(text.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_start"])

        return run

    rows = id_text(documents).select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for index, only in shards(spark, benchmark):
        found = rows.mapInArrow(lean(over(index)), SCHEMA)
        if only:
            return found
        out = out.unionByName(staged(spark, found, "leaks"))
        index.unpersist()
    return out


def drop_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    at, schema = documents.columns.index("text"), documents.schema

    def over(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(index.value)
            for b in batches:
                yield b.filter(pa.array([not m.match(t.as_py()) for t in b.column(at)], pa.bool_()))

        return run

    for index, only in shards(spark, benchmark):
        documents = documents.mapInArrow(lean(over(index)), schema)
        if not only:
            documents = staged(spark, documents, "clean")
            index.unpersist()
    return documents
