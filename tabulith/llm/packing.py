"""Lexical retrieval packing: a sharded BM25 inverted index chooses what shares a window.

Documents are tokenised once and staged. They are ranged by a lexical key (the scrambled smallest
hash of their bigrams, so that texts with common words lie together and long texts lie as anywhere
as short ones) into parts of equally many tokens: the tokens of 65,536 cells of the key are counted,
and a cell that holds much more than its share, a group of copies say, is dealt over parts by a hash
of the id. A part is cut into shards of a bounded number of tokens and documents. In each shard a
BM25 inverted index over token ids, with document frequencies counted over all documents, returns
for each seed document its unused neighbours by falling score over all terms of the seed; they fill
the seed's window greedily. The neighbour that does not fit is cut, and its rest seeds the next
window. What is left at the end of a part is cut into pieces whose lengths are powers of two, so
nothing is padded. Neighbours are those of the same shard; others are not looked for.

Defined results: null and empty texts are the end mark alone; documents longer than a window
run over several; ties of scores go by place; repeated rows and rows with a null doc_id are packed
one by one; an empty table gives no pieces; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import id_text, lean, mix64, staged

WINDOW = 2048
END = 1
VOCABULARY = 1 << 16
#: A shard ends with the document that brings it to so many tokens, or to so many documents.
SHARD_TOKENS, SHARD_DOCUMENTS = 1_500_000, 16_384
#: Terms of a seed, those that weigh most in it, that find candidates, and the candidates that are scored by
#: all terms: 0.98 of the eight best by all terms are found (tests/llm/test_packing.py measures it).
QUERY_TERMS, CANDIDATES = 32, 128
#: Tokens of a part, which one task packs.
PART_TOKENS = 4 * SHARD_TOKENS
#: Cells of the key whose tokens are counted, and how many times its share makes a cell a hot one.
CELLS, HOT_CELL = 1 << 16, 4
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"


class Tokenizer:
    """Token ids of whole texts as little-endian uint16, by the byte-level BPE file `name`.

    Pieces between single spaces never share a token in this vocabulary's split pattern, so a group of
    texts is cut into pieces at once, each distinct piece is encoded once, and texts are put together
    from them; texts with other white space at a piece's edge are encoded whole.
    `name` + ".tiktoken" holds the same merges and is the faster reader; texts that hold a special
    token's string, or that its split pattern cannot take, go to the tokenizers library itself.
    """

    def __init__(self, name: str = "byte_bpe_50k", most: int = 300_000):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.name = name
        self.core = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = Pieces(self.core.encode_ordinary, most)

    @functools.cached_property
    def whole(self):
        import public_tokenizers
        from tokenizers import Tokenizer as Whole

        return Whole.from_file(public_tokenizers.path(self.name + ".json"))

    def encode(self, text: str) -> bytes:
        """One text as a whole."""
        if SPECIAL not in text:
            try:
                return array("H", self.core.encode_ordinary(text)).tobytes()
            except ValueError:  # a run of white space too long for the split pattern
                pass
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str], most: int = 16 << 20) -> list[bytes]:
        """Texts in groups of about `most` characters."""
        out, start, held = [], 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= most or k == len(texts) - 1:
                out += self._group(texts[start : k + 1])
                start, held = k + 1, 0
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), pattern=" ")
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        ids = [self.pieces[w] for w in words.dictionary.to_pylist()]
        first = np.zeros(len(words), bool)
        first[ends[:-1]] = True
        codes = words.indices.to_numpy()
        odd = np.array([x is None for x in ids])[codes] & ~first
        odd = np.add.reduceat(odd.astype(np.int64), ends[:-1]) > 0
        rest = pa.array(ids, pa.large_binary()).take(pa.array(codes[~first]))
        _, at, data = rest.buffers()
        at = np.frombuffer(at, np.int64)[ends - np.arange(len(ends))].tolist()
        data = memoryview(data) if data is not None else memoryview(b"")
        out = []
        for k, text in enumerate(texts):
            head = text.partition(" ")[0]
            if odd[k] or head[-1:].isspace() or SPECIAL in text or len(head) > 1_000:
                out.append(self.encode(text))
            else:
                out.append(array("H", self.core.encode_ordinary(head)).tobytes() + bytes(data[at[k] : at[k + 1]]))
        return out


class Pieces(dict):
    """Ids of a piece with the space before it, None if it must be seen with its text."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace() or len(piece) > 1_000:
            return None
        if len(self) >= self.most:
            self.clear()
        self[piece] = ids = array("H", self.encode(" " + piece)).tobytes()
        return ids


def tokenised(documents: DataFrame) -> DataFrame:
    """kind 0: a document's ids and lexical key; kind 1: a task's document frequencies, as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, df = Tokenizer(), np.zeros(VOCABULARY, np.int64)
        names = ["kind", "doc_id", "row", "ids", "n", "key"]

        def batch(kind, doc, row, ids, n, key):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.int64())], names=names)

        for b in batches:
            blobs, sizes, least = [], [], []
            for blob in tok.encode_all(b.column(2).to_pylist()):
                blob += b"\x01\x00"
                ids = np.frombuffer(blob, np.uint16)
                df[np.unique(ids)] += 1
                blobs.append(blob)
                sizes.append(len(ids))
                pairs = ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:]
                least.append((pairs * np.uint64(0x9E3779B97F4A7C15)).min() if len(pairs) else 0)
            keys = mix64(np.array(least, np.uint64)) >> np.uint64(1)
            m = len(blobs)
            yield batch([0] * m, b.column(0), b.column(1), blobs, sizes, keys)
        used = np.flatnonzero(df)
        if len(used):
            yield batch([1], [None], [None], [np.stack([used, df[used]]).astype(np.int64).tobytes()], [len(used)], [None])

    rows = id_text(documents).select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(lean(run), "kind int, doc_id long, row long, ids binary, n long, key long")


def document_frequencies(stage: DataFrame) -> np.ndarray:
    """Over all documents; the vocabulary bounds what is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for blob in b.column(0):
                token, count = np.frombuffer(blob.as_py(), np.int64).reshape(2, -1)
                total[token] += count
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["token", "df"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in stage.where("kind = 1").select("ids").mapInArrow(lean(run), "token int, df long").groupBy("token").agg(F.sum("df").alias("df")).collect():
        out[r["token"]] = r["df"]
    return out


class Shard:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.n = docs, len(docs)
        lens = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) | np.repeat(np.arange(self.n, dtype=np.int64), lens) << 16
        flat.sort()
        edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        tf = np.diff(np.r_[edge, len(flat)]).astype(np.float32)
        token, doc = flat[edge] & 0xFFFF, flat[edge] >> 16
        norm = K1 * (1 - B + B * lens / mean)
        weight = (idf[token] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.from_doc, self.token, self.weight = np.searchsorted(doc, np.arange(self.n + 1)), token, weight
        order = np.argsort(token, kind="stable")
        self.doc_by_token, self.weight_by_token = doc[order], weight[order]
        self.start = np.searchsorted(token[order], np.arange(VOCABULARY + 1))
        self.mark = np.zeros(VOCABULARY, bool)

    def scores(self, seed: int, most: int | None = None) -> np.ndarray:
        """BM25 of every document against the seed's terms, or the `most` heaviest of them."""
        a, z = self.from_doc[seed], self.from_doc[seed + 1]
        token, w = self.token[a:z], self.weight[a:z]
        if most and len(token) > most:
            token = token[np.argpartition(-w, most)[:most]]
        spans = [(self.start[t], self.start[t + 1]) for t in token]
        return np.bincount(np.concatenate([self.doc_by_token[s:e] for s, e in spans]), np.concatenate([self.weight_by_token[s:e] for s, e in spans]), self.n)

    def rescored(self, seed: int, some: np.ndarray) -> np.ndarray:
        """The score of some documents against all terms of the seed."""
        self.mark[self.token[self.from_doc[seed] : self.from_doc[seed + 1]]] = True
        lens = self.from_doc[some + 1] - self.from_doc[some]
        ends = np.cumsum(lens)
        at = np.repeat(self.from_doc[some] - (ends - lens), lens) + np.arange(ends[-1])
        got = np.add.reduceat(self.weight[at] * self.mark[self.token[at]], ends - lens)
        self.mark[:] = False
        return got

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score (then by place): the best by the seed's heaviest terms are scored
        by all of them, and so on with the next; each that is taken is marked by the caller."""
        score, some = self.scores(seed, QUERY_TERMS), CANDIDATES
        while True:
            left = np.flatnonzero(unused)
            if not len(left):
                return
            if len(left) > some:
                least = np.partition(score[left], -some)[-some]
                better, level = left[score[left] > least], left[score[left] == least]
                left = np.concatenate([better, level[: some - len(better)]])
            yield from left[np.lexsort((left, -self.rescored(seed, left)))].tolist()
            some *= 4  # short documents: the window has room for more


def order_of(shard: Shard) -> Iterator[int]:
    """The documents of a shard in the order in which they fill windows."""
    unused = np.ones(shard.n, bool)
    filled, seed, at = 0, -1, 0
    while True:
        while at < shard.n and not unused[at]:
            at += 1
        if at == shard.n:
            return
        if seed < 0:
            seed = at
            unused[seed] = False
            yield seed
            filled = len(shard.docs[seed]) % WINDOW
        for d in shard.neighbours(seed, unused):
            unused[d] = False
            yield d
            filled += len(shard.docs[d])
            if filled >= WINDOW:  # cut here: the rest of d seeds the next window
                filled %= WINDOW
                seed = d
                break


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_partition(idf: np.ndarray, mean: float, batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one partition, in order; `first` is its first sequence id."""
    out: list[tuple] = []
    sequence, room = first, 0  # room: tokens in the open window
    open_: list[tuple] = []  # pieces of the open window: doc_id, start, ids, doc_tokens

    def emit(pieces: list[tuple], seq: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset))
            offset += len(ids)

    def table() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def pack(ids_list: list, docs: list[np.ndarray]) -> None:
        nonlocal sequence, room, open_
        for k in order_of(Shard(docs, idf, mean)):
            ids, start = docs[k], 0
            while start < len(ids):
                part = ids[start : start + WINDOW - room]
                open_.append((ids_list[k], start, part, len(ids)))
                room += len(part)
                start += len(part)
                if room == WINDOW:
                    emit(open_, sequence)
                    sequence, room, open_ = sequence + 1, 0, []

    names: list = []
    docs: list[np.ndarray] = []
    held = 0
    for b in batches:
        for doc, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.frombuffer(blob.as_py(), np.uint16)
            names.append(doc)
            docs.append(ids)
            held += len(ids)
            if held >= SHARD_TOKENS or len(docs) >= SHARD_DOCUMENTS:
                pack(names, docs)
                names, docs, held = [], [], 0
                yield table()
                out.clear()
    if docs:
        pack(names, docs)
    while open_:  # what is left, in sequences whose lengths are powers of two
        size, pieces = 1 << (sum(len(p[2]) for p in open_).bit_length() - 1), []
        while size:
            doc, start, ids, total = open_.pop(0)
            pieces.append((doc, start, ids[:size], total))
            if len(ids) > size:
                open_.insert(0, (doc, start + size, ids[size:], total))
            size -= len(pieces[-1][2])
        emit(pieces, sequence)
        sequence += 1
    yield table()


def pack_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""
    stage = staged(spark, tokenised(documents), "tokens")
    held = stage.where("kind = 0")
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    df = document_frequencies(stage)
    idf = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, total["t"] / max(1, total["n"]))
    model = spark.sparkContext.broadcast((idf, mean))  # the vocabulary bounds it
    cell = F.shiftright("key", 63 - 16)
    sums = sorted((r[0], r[1]) for r in held.groupBy(cell.alias("cell")).agg(F.sum("n").alias("t")).collect())  # at most CELLS
    target, cells, before = PART_TOKENS, [], 0
    parts = max(1, -(-int(total["t"]) // target))
    target = max(1, -(-int(total["t"]) // parts))
    for c, t in sums:
        cells.append((c, before, t, t > HOT_CELL * max(1, total["t"]) / CELLS and t > target // HOT_CELL))
        before += t
    plan = spark.createDataFrame(cells, "cell long, before long, t long, hot boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from packed_partition(*model.value, batches, TaskContext.get().partitionId() << 40)

    low = (1 << 47) - 1  # the key's bits below those of its cell
    inside = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << 20)) / float(1 << 20)).otherwise(F.col("key").bitwiseAND(low) / float(1 << 47))
    part = F.least(F.lit(parts - 1), F.floor((F.col("before") + inside * F.col("t")) / target)).cast("int")
    where = ["key", F.xxhash64("doc_id", "row"), "doc_id", "row"]
    spread = held.select("doc_id", "ids", "key", "row").withColumn("cell", cell).join(F.broadcast(plan), "cell").withColumn("part", part)
    spread = spread.select("doc_id", "ids", "key", "row", "part").repartitionById(parts, "part").sortWithinPartitions(*where)
    return spread.select("doc_id", "ids").mapInArrow(lean(run), SCHEMA)
