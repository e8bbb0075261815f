"""N-gram Jaccard self-join with several global orders.

Two texts whose shingle sets reach the threshold share a token among the first
n - ceil(t * n) + 1 of each set, under *any* global order of tokens. Three orders are used: by
rising frequency (from a count sketch over all documents, ties by hash), by rising hash and by
falling hash. Candidates come from the prefixes of the first order, where frequent tokens come
last, and pass length and position bounds; then the filters of the other two orders are intersected
with it: both ends' prefixes under these orders, kept with each node in few bits a token, must meet.
Only pairs that pass all three orders (and the parity bound, below) get their texts fetched.

Documents with equal sets are one node. All links between nodes are found, though not all pairs
are looked at: (1) in every group of nodes that share a prefix token each node is compared with
the group's hub, the node in which the token stands earliest; (2) with the components of those
links known, the pairs of a group that lie in different components are compared. A pair within
one component cannot change the components. Before a pair of step (2) is made, the parity bits
of its two sets bound what they can have in common: sets whose bits differ in h places differ in
h shingles at least, so no link is lost.

Postings travel as compressed blocks per part of the token space. Tokens that more than
`hot` documents hold are dealt over several parts by node; the hubs of those parts are compared
with one of them. In step (2) tokens with more than `big` nodes leave their part: nodes outside the
token's main component and all its nodes are dealt into chunks by size and hash, and every pair of
chunks is a group of its own.

Defined results: lower-casing covers A-Z only, words end at ASCII white space only; texts of
fewer words than a shingle are one shingle; empty and null texts have no shingle and are linked
with nothing; rows with a null doc_id are linked with nothing and have a null component; repeated
rows are copies of each other; rows that repeat a doc_id with another text are documents of their
own, whose component is the smallest doc_id among those linked to them; ties between hubs go by
fingerprint; empty tables give an empty result; texts are read whole, whatever their length; other
columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import WordHashes, components, join_groups, lean, lean_groups, mix64, numbered, shingles, shuffle_width, staged, words_of

#: Cells of the count sketch: what is broadcast has these bounds whatever the data.
CELLS = (1 << 20, 1 << 23)
#: Postings of one part, which one task holds at a time.
PART_POSTINGS = 2_000_000
#: Documents of one token, by the sketch, from which it is dealt over several parts.
HOT = 1_000_000
#: Postings of a part where there are few: so small data have more than a task.
LEAST_POSTINGS = 100_000
#: Nodes of a token whose pairs are all compared at once.
FEW = 8
#: Nodes of one token whose pairs one task may compare; above, chunks of so many are compared.
BIG, CHUNK = 1_500, 1_000
#: Parity bits of a node, by its size: two a shingle, within these bounds.
BITS = (64, 2048)
#: Rows of a few numbers that may be broadcast; more are joined by sorting.
FEW_ROWS = 1_000_000


def least_common(nx, ny):
    """Common shingles at which 100 * common >= 80 * union."""
    return (4 * (nx + ny) + 8) // 9


def prefix(n):
    return n - (4 * n + 4) // 5 + 1


def fingerprint(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def bit_width(n: int) -> int:
    """Parity bits of a set of n shingles: a power of two."""
    return min(BITS[1], max(BITS[0], 1 << (2 * n - 1).bit_length()))


def parity(s: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of shingles falls on k."""
    width = bit_width(len(s))
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class ParityBound:
    """Least number of shingles in which two nodes of a list differ, by their parity bits."""

    def __init__(self, bits: list[bytes]):
        lens = np.array([len(x) for x in bits], np.int64)
        self.width = lens // 8  # in words of 64 bits
        self.row = np.zeros(len(bits), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.rows[int(w)] = np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), int(w))

    def folds(self, w: int, to: int) -> np.ndarray:
        """Bits of width w as those of the narrower width `to`."""
        if (w, to) not in self.folded:
            rows = self.rows[w]
            while rows.shape[1] > to:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            self.folded[w, to] = rows
        return self.folded[w, to]

    def apart(self, i: np.ndarray, j: np.ndarray, step: int = 100_000) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        wi, wj = self.width[i], self.width[j]
        for a in np.unique(wi):
            for b in np.unique(wj[wi == a]):
                to = int(min(a, b))
                x, y = self.folds(int(a), to), self.folds(int(b), to)
                at = np.flatnonzero((wi == a) & (wj == b))
                for k in range(0, len(at), step):
                    p = at[k : k + step]
                    out[p] = np.bitwise_count(x[self.row[i[p]]] ^ y[self.row[j[p]]]).sum(1, dtype=np.int64)
        return out


def signature(s: np.ndarray) -> bytes:
    """The prefixes of a set under rising and falling hash order: 16 bits of a token, 32 in long ones."""
    p = prefix(len(s))
    kind = np.uint16 if p <= 128 else np.uint32
    low, high = (np.unique((x >> np.uint64(8)).astype(kind)) for x in (s[:p], s[-p:]))
    return bytes([kind().itemsize]) + len(low).to_bytes(4, "little") + low.tobytes() + high.tobytes()


def orders(blob: bytes, width: int | None = None) -> tuple[set, set]:
    """The two prefixes of a signature, in 16 bits if asked for."""
    size, n = blob[0], int.from_bytes(blob[1:5], "little")
    x = np.frombuffer(blob, np.uint16 if size == 2 else np.uint32, offset=5)
    if width == 2 != size:
        x = x.astype(np.uint16)
    return set(x[:n].tolist()), set(x[n:].tolist())


def orders_meet(x: bytes, y: bytes) -> bool:
    """Whether both prefixes of two sets can share a token; false only where they share none."""
    width = min(x[0], y[0])
    (a, b), (c, d) = orders(x, width), orders(y, width)
    return not a.isdisjoint(c) and not b.isdisjoint(d)


# ---- pass one: nodes and the sketch ---------------------------------------------------------

DESCRIBED = "kind int, doc_id long, row long, fp long, n long, bits binary, sig binary"


def cells_for(documents: DataFrame) -> int:
    """Enough cells for a thousand shingles each, within CELLS, by the planner's size of the input."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cells = CELLS[0]
    while cells < CELLS[1] and cells < min(size, 1 << 50) // 6000:
        cells *= 2
    return cells


def described(rows: DataFrame, cells_of_sketch: int) -> DataFrame:
    """kind 0: a document's node (fp, n, parity bits, prefixes); kind 1: a task's sketch of its shingles, in bits."""
    names = ["kind", "doc_id", "row", "fp", "n", "bits", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(cells_of_sketch, np.int32)
        mask = np.uint64(cells_of_sketch - 1)
        for b in batches:
            fps, ns, cells, bits, sigs = [], [], [], [], []
            for text in b.column(2):
                s = shingles(words_of(text.as_py()), hashes)
                cells.append((s & mask).astype(np.int32))
                fps.append(fingerprint(s))
                ns.append(len(s))
                bits.append(parity(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            if cells:
                seen, times = np.unique(np.concatenate(cells), return_counts=True)
                counts[seen] += times.astype(np.int32)
            m = len(fps)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(bits, pa.binary()), pa.array(sigs, pa.binary())], names=names)
        if counts.any():
            none = [pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *none, pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()), pa.nulls(1, pa.binary())], names=names)

    return rows.mapInArrow(lean(run), DESCRIBED)


def merged_sketch(stage: DataFrame, cells: int) -> np.ndarray:
    """The sum of all sketches, by a tree of merges of at most 32 at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column(0):
                part = np.frombuffer(zlib.decompress(blob.as_py()), np.int32)
                total = part.copy() if total is None else np.minimum(total.astype(np.int64) + part, 2**31 - 1).astype(np.int32)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["sketch"])

    rows = stage.where("kind = 1").select(F.col("bits").alias("sketch")).mapInArrow(lean(merge), "sketch binary")
    parts = stage.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 32)
        rows = rows.repartition(parts).mapInArrow(lean(merge), "sketch binary")
    got = rows.collect()
    return np.frombuffer(zlib.decompress(bytes(got[0][0])), np.int32) if got else np.zeros(cells, np.int32)


# ---- pass two: postings and candidates ------------------------------------------------------


def pack(token, doc, pos, fps, ns) -> bytes:
    docs, local = np.unique(doc, return_inverse=True)
    order = np.argsort(token, kind="stable")
    head = np.array([len(token), len(docs)], np.int64)
    body = [np.diff(token[order], prepend=np.uint64(0)), local[order].astype(np.uint32), pos[order].astype(np.uint32), fps[docs], ns[docs].astype(np.int64)]
    planes = b"".join(np.ascontiguousarray(np.frombuffer(x.tobytes(), np.uint8).reshape(len(x), -1).T).tobytes() for x in body)
    return zlib.compress(head.tobytes() + planes, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """token, pos, fp, n of every posting in a block."""
    raw = zlib.decompress(blob)
    m, d = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, count in ((np.uint64, m), (np.uint32, m), (np.uint32, m), (np.int64, d), (np.int64, d)):
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += width * count
    gaps, local, pos, fps, ns = out
    return np.cumsum(gaps, dtype=np.uint64), pos.astype(np.int64), fps[local], ns[local]


def postings(rows: DataFrame, sketch, parts: int, hot: int) -> DataFrame:
    """Blocks (part, block) of the prefix tokens of every node that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        counts = sketch.value
        mask = np.uint64(len(counts) - 1)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            token = np.concatenate([h[0] for h in held])
            lens = [len(h[0]) for h in held]
            doc = np.repeat(np.arange(len(held)), lens)
            pos = np.concatenate([np.arange(k) for k in lens])
            fps, ns = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            salts = np.maximum(1, -(-counts[(token & mask).astype(np.int64)].astype(np.int64) // hot)).astype(np.uint64)
            salt = mix64(fps.view(np.uint64))[doc] % salts
            part = (mix64(token + salt * np.uint64(0x632BE59BD9B4E019)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            ids = [k for k in range(parts) if edges[k] < edges[k + 1]]
            blobs = [pack(token[o], doc[o], pos[o], fps, ns) for o in (order[edges[k] : edges[k + 1]] for k in ids)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(2), strict=True):
                if not doc_id.is_valid:
                    continue
                s = shingles(words_of(text.as_py()), hashes)
                n = len(s)
                if not n:
                    continue
                fp = fingerprint(s)
                if (fp, n) in seen:  # copies within a task post once
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((fp, n))
                first = np.argsort(counts[(s & mask).astype(np.int64)], kind="stable")[: prefix(n)]
                held.append((s[first], fp, n))
                size += len(first)
                if size >= 1_000_000:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(lean(run), "part long, block binary")


def gathered(blocks: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Distinct postings of a part by (token, pos, fp), without tokens that one node alone holds."""
    got = [unpack(x.as_py()) for x in blocks]
    token, pos, fp, n = (np.concatenate([g[k] for g in got]) for k in range(4))
    order = np.lexsort((fp, pos, token))
    token, pos, fp, n = token[order], pos[order], fp[order], n[order]
    same = np.r_[False, (token[1:] == token[:-1]) & (fp[1:] == fp[:-1]) & (n[1:] == n[:-1])]
    token, pos, fp, n = token[~same], pos[~same], fp[~same], n[~same]
    return token, pos, fp, n


def runs(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)


def possible(pa_, na, pb, nb):
    """Length and position bounds for two nodes that share a token at places pa_ and pb."""
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (most >= least_common(na, nb))


def distinct_pairs(a, an, b, bn) -> np.ndarray:
    """Four rows: a, its size, b, its size."""
    got = np.stack([a, an, b, bn]).astype(np.int64)
    if got.shape[1] < 2:
        return got
    got = got[:, np.lexsort(got)]
    return got[:, np.r_[True, (got[:, 1:] != got[:, :-1]).any(0)]]


PAIR = "a long, an long, b long, bn long"


def first_candidates(blocks: DataFrame, sketch, parts: int, hot: int, big: int) -> DataFrame:
    """kind 0: node with hub; kind 1: the part's postings of shared tokens; kind 2: postings of tokens that
    are dealt or have many nodes (a, an: node, bn: place), with b = 1 for the hub of the part."""

    def rows(kind: int, part: int, a, an, b, bn, token=None, block: bytes | None = None) -> pa.Table:
        m = len(a)
        token = np.zeros(m, np.int64) if token is None else token
        cols = [pa.array(np.full(m, kind), pa.int32()), pa.array(np.full(m, part), pa.int64()), *(pa.array(x, pa.int64()) for x in (a, an, b, bn, token))]
        return pa.Table.from_arrays([*cols, pa.array([block] * m, pa.binary())], names=["kind", "part", "a", "an", "b", "bn", "token", "block"])

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        token, pos, fp, n = gathered(table.column("block"))
        out = []
        size = np.diff(runs(token))
        size = np.repeat(size, size)
        dealt = sketch.value[(token & np.uint64(len(sketch.value) - 1)).astype(np.int64)] > hot
        apart = dealt | (size > big)
        if apart.any():
            head = np.zeros(len(token), np.int64)
            head[runs(token)[:-1]] = 1
            out.append(rows(2, part, fp[apart], n[apart], head[apart], pos[apart], token[apart].view(np.int64)))
        shared = size >= 2
        token, pos, fp, n, apart = token[shared], pos[shared], fp[shared], n[shared], apart[shared]
        if len(token):
            edge = runs(token)
            size = np.repeat(np.diff(edge), np.diff(edge))
            after = np.repeat(edge[1:], np.diff(edge))
            at, to = np.flatnonzero(size > FEW), np.repeat(edge[:-1], np.diff(edge))[size > FEW]
            few = [np.flatnonzero((size <= FEW) & (np.arange(len(token)) + d < after)) for d in range(1, FEW)]
            at = np.concatenate([at, *(x + d for d, x in enumerate(few, 1))])
            to = np.concatenate([to, *few])
            fits = possible(pos[at], n[at], pos[to], n[to]) & (at != to)
            at, to = at[fits], to[fits]
            swap = ~(size[at] > FEW) & ((fp[to] > fp[at]) | (fp[to] == fp[at]) & (n[to] > n[at]))  # hubs come first, other pairs by fingerprint
            at, to = np.where(swap, to, at), np.where(swap, at, to)
            out.append(rows(0, part, *distinct_pairs(fp[to], n[to], fp[at], n[at])))
            apart = apart | (size <= FEW)
            token, pos, fp, n = token[~apart], pos[~apart], fp[~apart], n[~apart]
        if len(token):
            zero = np.zeros(1, np.int64)
            nodes, local = np.unique(np.stack([fp, n]), axis=1, return_inverse=True)
            out.append(rows(1, part, zero, zero, zero, zero, None, pack(token, local.ravel(), pos, nodes[0], nodes[1])))
        none = np.zeros(0, np.int64)
        return pa.concat_tables(out) if out else rows(0, part, none, none, none, none)

    # As many tasks as parts at least: the planner knows the blocks' bytes, not what is in them.
    blocks = blocks.repartition(max(parts, shuffle_width(blocks.sparkSession)), "part")
    return blocks.groupBy("part").applyInArrow(lean_groups(reduce), "kind int, part long, " + PAIR + ", token long, block binary")


def dealt_hubs(blocks: DataFrame) -> DataFrame:
    """The hubs of the parts of a dealt token, each with the first of them."""
    heads = blocks.where("kind = 2 AND b = 1").select("token", "bn", "a", "an")
    first = heads.groupBy("token").agg(F.min(F.struct("bn", "a", "an")).alias("f"))
    got = heads.join(first, "token").select(F.col("f.a").alias("a"), F.col("f.an").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))
    return got.where("a <> b OR an <> bn")


def across(left: tuple, right: tuple, step: int = 2_000_000) -> np.ndarray:
    """Pairs of left and right nodes (fp, n, pos, label, place in bound, with the bound last) of different
    components that pass the bounds, the parity bits' too."""
    bound, found = left[5], []
    by_size = lambda side: [c[np.argsort(side[1], kind="stable")] for c in side[:5]]
    fp, n, pos, label, lo = by_size(left)
    fp2, n2, pos2, label2, lo2 = by_size(right)
    k = 0
    while k < len(fp):  # nodes of like size stand together, so few of the others come in question
        first = int(np.searchsorted(n2, -(-4 * n[k] // 5)))
        rows = max(1, step // max(1, len(fp2) - first))
        x = np.arange(k, min(len(fp), k + min(rows, 512)))
        y = np.arange(first, int(np.searchsorted(n2, 5 * n[x[-1]] // 4, "right")))
        k = int(x[-1]) + 1
        i, j = np.nonzero(possible(pos[x, None], n[x, None], pos2[y], n2[y]) & (label[x, None] != label2[y]))
        i, j = x[i], y[j]
        fits = n[i] + n2[j] - bound.apart(lo[i], lo2[j]) >= 2 * least_common(n[i], n2[j])
        i, j = i[fits], j[fits]
        a, an, b, bn = fp[i], n[i], fp2[j], n2[j]
        swap = (a > b) | (a == b) & (an > bn)
        if len(i):
            found.append(distinct_pairs(np.where(swap, b, a), np.where(swap, bn, an), np.where(swap, a, b), np.where(swap, an, bn)))
    return distinct_pairs(*np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64)


def within(token, pos, fp, n, label, lo, bound, step: int = 500_000) -> Iterator[np.ndarray]:
    """Pairs of postings sorted by (token, label) that share a token, of different components, that pass the
    bounds: each with the one `d` places after it in all groups at once, for every d."""
    edge = runs(token)
    size = np.diff(edge)
    mixed = np.repeat(label[edge[:-1]] != label[edge[1:] - 1], size)
    after = np.repeat(edge[1:], size)
    at, d, held, have = np.flatnonzero(mixed), 0, [], 0
    while True:
        d += 1
        at = at[at + d < after[at]]
        if len(at):
            fits = possible(pos[at], n[at], pos[at + d], n[at + d]) & (label[at] != label[at + d])
            held.append((at[fits], at[fits] + d))
            have += len(held[-1][0])
        if held and (have >= step or not len(at)):
            i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            swap = (fp[i] > fp[j]) | (fp[i] == fp[j]) & (n[i] > n[j])
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            _, one = np.unique(np.stack([lo[i], lo[j]]), axis=1, return_index=True)  # each pair's bits are compared once
            i, j = i[one], j[one]
            fits = n[i] + n[j] - bound.apart(lo[i], lo[j]) >= 2 * least_common(n[i], n[j])
            i, j = i[fits], j[fits]
            yield np.stack([fp[i], n[i], fp[j], n[j]])
            held, have = [], 0
        if not len(at):
            return


def pair_table(got: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "an", "b", "bn"])


def dealt_candidates(spark: SparkSession, blocks: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """Nodes of a token of kind 2 outside its main component, with its nodes in other components: both
    are dealt into chunks of about `chunk`, among nodes of like size, and each pair of chunks is one group."""
    held = blocks.where("kind = 2").select("token", F.col("a").alias("fp"), F.col("an").alias("n"), F.col("bn").alias("pos"))
    held = held.groupBy("token", "fp", "n").agg(F.min("pos").alias("pos")).join(labels, ["fp", "n"])
    held = staged(spark, held.withColumn("len", F.floor(F.log("n") / math.log(1.25) + 1e-9).cast("int")), "dealt")
    sizes = held.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("nodes"), F.count("*").alias("parts"))
    sizes = staged(spark, sizes.where("parts > 1"), "dealt-tokens")
    total = 1_000_000
    ends = ["token", "len"]
    x = join_groups(held, sizes, ["token"], "nodes", total).where("label <> main").select(held.columns)
    x = staged(spark, x.withColumn("len", F.explode(F.array(F.col("len") - 1, "len", F.col("len") + 1))), "dealt-outside")
    nx = x.groupBy(*ends).agg(F.count("*").alias("nx"))
    ny = held.join(sizes.select("token"), "token", "left_semi").groupBy(*ends).agg(F.count("*").alias("ny"))
    plan = nx.join(ny, ends).select(*ends, (F.col("nx") + F.col("ny")).alias("size"), F.ceil(F.col("nx") / chunk).cast("int").alias("bx"), F.ceil(F.col("ny") / chunk).cast("int").alias("by"))
    plan = staged(spark, plan, "dealt-plan")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = [*ends, "cx", "cy", "fp", "n", "pos", "label", "bits"]
    x = join_groups(x, plan, ends, "size", total).withColumn("cx", F.pmod(F.xxhash64("fp", "n"), "bx").cast("int")).withColumn("cy", upto("by")).select(columns)
    y = join_groups(held, plan, ends, "size", total).withColumn("cy", F.pmod(F.xxhash64("n", "fp"), "by").cast("int")).withColumn("cx", upto("bx")).select(columns)

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pair_table(np.zeros((4, 0), np.int64))
        bound = ParityBound(left.column(8).to_pylist() + right.column(8).to_pylist())
        of = lambda t, first: (*(t.column(k).to_numpy() for k in range(4, 8)), np.arange(first, first + t.num_rows), bound)
        return pair_table(across(of(left, 0), of(right, left.num_rows)))

    named = lambda df, side: df.toDF(*(f"{side}_{c}" for c in columns)).groupBy(*(f"{side}_{c}" for c in columns[:4]))
    return named(x, "x").cogroup(named(y, "y")).applyInArrow(cross, PAIR)


def later_candidates(spark: SparkSession, blocks: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """Pairs of a token's nodes that pass the bounds, the parity bits' too, and lie in different components."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block in zip(b.column(0), b.column(1), strict=True):
                _, _, fp, n = unpack(block.as_py())
                nodes = np.unique(np.stack([fp, n]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(nodes.shape[1], part.as_py()), pa.int64()), pa.array(nodes[0], pa.int64()), pa.array(nodes[1], pa.int64())], names=["part", "fp", "n"])

    def cross(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            got = [unpack(x.as_py()) for x in left.column("block")]
            token, pos, fp, n = (np.concatenate([g[k] for g in got]) for k in range(4))
            nodes = np.stack([right.column(c).to_numpy() for c in ("fp", "n", "label")])
            sort = np.lexsort((nodes[1], nodes[0]))
            nodes, bound = nodes[:, sort], ParityBound(right.column("bits").take(pa.array(sort)).to_pylist())
            lo = np.searchsorted(nodes[0], fp)
            while True:  # equal fingerprints of different sizes are told apart
                off = (nodes[0][np.minimum(lo, nodes.shape[1] - 1)] == fp) & (nodes[1][np.minimum(lo, nodes.shape[1] - 1)] != n)
                if not off.any():
                    break
                lo = lo + off
            lo = np.minimum(lo, nodes.shape[1] - 1)
            label = nodes[2][lo]
            order = np.lexsort((label, token))
            token, pos, fp, n, label, lo = token[order], pos[order], fp[order], n[order], label[order], lo[order]
            found.extend(within(token, pos, fp, n, label, lo, bound))
        return pair_table(distinct_pairs(*np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64))

    held = blocks.where("kind = 1").select("part", "block")
    nodes = held.mapInArrow(lean(members), "part long, fp long, n long").join(labels, ["fp", "n"])
    got = held.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(lean_groups(cross), PAIR)
    if blocks.where("kind = 2").limit(1).count():
        got = got.union(dealt_candidates(spark, blocks, labels, chunk))
    return got.distinct()


# ---- the filters of all orders, and verification ----------------------------------------------


def matched(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table of short rows: broadcast if that has at most FEW_ROWS."""
    return rows.join(F.broadcast(few) if few.count() <= FEW_ROWS else few.hint("merge"), keys, how)


def intersected(spark: SparkSession, pairs: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes that pass every order's filter and the parity bound; written.
    held: rows with fp, n and the prefixes of every document."""
    ends = pairs.select(F.col("a").alias("fp"), F.col("an").alias("n")).union(pairs.select("b", "bn"))
    ends = staged(spark, ends.groupBy("fp", "n").agg(F.count("*").alias("times")), "ends")
    signs = matched(held, ends, ["fp", "n"]).groupBy("fp", "n").agg(F.first("sig").alias("sig"))
    known = matched(nodes, ends, ["fp", "n"]).join(signs, ["fp", "n"])
    known = staged(spark, known.select("fp", "n", "times", "node", "bits", "sig"), "pair-nodes")
    side = lambda end, size, out: known.select(F.col("fp").alias(end), F.col("n").alias(size), "times", F.col("node").alias(out), F.col("bits").alias(f"{out}_bits"), F.col("sig").alias(f"{out}_sig"))
    # A hub may be in any number of pairs, a node with it in as many as its prefix has tokens.
    named = join_groups(pairs, side("a", "an", "x"), ["a", "an"], "times", 1_000_000).drop("times")
    named = named.join(side("b", "bn", "y").hint("merge"), ["b", "bn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x, y, an, bn = (b.column(k).to_numpy() for k in range(4))
            bits = [b.column(k).to_pylist() for k in (4, 5)]
            apart = ParityBound(bits[0] + bits[1]).apart(np.arange(m), np.arange(m, 2 * m))
            at = np.flatnonzero(an + bn - apart >= 2 * least_common(an, bn))
            sx, sy = b.column(6), b.column(7)
            at = [k for k in at.tolist() if orders_meet(sx[k].as_py(), sy[k].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()), pa.array(y[at], pa.int64())], names=["x", "y"])

    return staged(spark, named.select("x", "y", "an", "bn", "x_bits", "y_bits", "x_sig", "y_sig").mapInArrow(lean(run), "x long, y long"), "pairs")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= least_common(len(x), len(y))


def verified(spark: SparkSession, rows: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of the pairs (x, y) that reach the threshold.

    The text of every node in a pair goes to its hub x; a hub with many nodes is copied, so that no
    copy has much more than a task's share of all pairs.
    """
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    share = max(8, pairs.count() // (4 * width))
    hubs = staged(spark, pairs.groupBy("x").agg(F.count("*").alias("held")).withColumn("copies", F.ceil(F.col("held") / share).cast("int")), "hubs")
    sides = join_groups(pairs, hubs, ["x"], "held", 1_000_000)
    sides = sides.select(F.col("y").alias("node"), F.col("x").alias("hub"), F.pmod(F.xxhash64("y"), "copies").cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = hubs.select(F.col("x").alias("node"), F.col("x").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("role"))
    want = staged(spark, sides.unionByName(heads).join(nodes.select("node", "fp", "n", F.col("rep").alias("doc_id")), "node"), "wanted")
    texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    ids = staged(spark, want.select("doc_id").distinct(), "ids")
    if ids.count() <= FEW_ROWS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    sent = texts.join(want.hint("merge"), "doc_id").select("hub", "salt", "role", "node", "fp", "n", "text")
    sent = sent.repartition(width, "hub", "salt").sortWithinPartitions("hub", "salt", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        at, hub = None, None
        for b in batches:
            a, z = [], []
            hubs, salts, roles, own, fps, ns = (b.column(k).to_pylist() for k in range(6))
            for k, text in enumerate(b.column(6)):
                if (hubs[k], salts[k]) != at:
                    at, hub = (hubs[k], salts[k]), None
                if roles[k] == 1 and hub is None:
                    continue
                s = shingles(words_of(text.as_py()), hashes)
                if len(s) != ns[k] or fingerprint(s) != fps[k]:
                    continue  # another row with the same doc_id
                if roles[k] == 0:
                    hub = s
                elif linked(s, hub):
                    a.append(hubs[k])
                    z.append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return sent.mapInArrow(lean(run), "a long, b long").distinct()


# ---- the operator ---------------------------------------------------------------------------


def classes(spark: SparkSession, rows: DataFrame, part_postings: int = PART_POSTINGS, hot: int = HOT, big: int = BIG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row, n and component of every one of `rows` (doc_id, row, text)."""
    cells = cells_for(rows)
    stage = staged(spark, described(rows, cells), "nodes")
    held = stage.where("kind = 0").select("doc_id", "row", "fp", "n", "sig")
    prefixes = F.sum(F.when(F.col("n") > 0, prefix_column(F.col("n"))))
    total = held.agg(F.count("*").alias("rows"), F.coalesce(prefixes, F.lit(0)).alias("postings")).first()
    sketch = spark.sparkContext.broadcast(merged_sketch(stage, cells))
    nodes = stage.where("kind = 0 AND n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bits").alias("bits"))
    nodes = staged(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "classes")

    some = int(total["postings"])
    parts = max(1, -(-some // part_postings), min(shuffle_width(spark), some // LEAST_POSTINGS))
    blocks = staged(spark, first_candidates(postings(rows, sketch, parts, hot), sketch, parts, hot, big), "candidates")
    first = staged(spark, blocks.where("kind = 0").select("a", "an", "b", "bn").union(dealt_hubs(blocks)).distinct(), "pairs")
    links = staged(spark, verified(spark, rows, intersected(spark, first, nodes, held), nodes), "links")
    found = components(spark, links)
    known = matched(nodes.where(F.col("rep").isNotNull()), found, ["node"], "left").select("fp", "n", "bits", F.coalesce("label", "node").alias("label"))
    known = staged(spark, known, "labelled")
    swapped = first.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))
    more = later_candidates(spark, blocks, known, chunk).join(first.union(swapped), ["a", "an", "b", "bn"], "left_anti")
    more = staged(spark, more, "pairs")
    if more.limit(1).count():
        links = staged(spark, links.union(verified(spark, rows, intersected(spark, more, nodes, held), nodes)), "links")
        found = components(spark, links)
    # A component's name is its smallest doc_id.
    named = staged(spark, matched(nodes.select("node", "rep"), found, ["node"]), "named")
    least = named.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("held"))
    named = staged(spark, join_groups(named, least, ["label"], "held", 1_000_000).select("node", "least"), "named")
    decided = matched(nodes.select("node", "fp", "n", "size", "rep"), named, ["node"], "left")
    decided = staged(spark, decided.select("fp", "n", "size", F.coalesce("least", "rep").alias("component")), "decided")
    held = held.drop("sig")
    full = join_groups(held.where("n > 0"), decided, ["fp", "n"], "size", total["rows"])
    full = full.select("doc_id", "row", "n", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
    return full.unionByName(held.where("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("component")))


def jaccard_components(spark: SparkSession, documents: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), "text")
    return classes(spark, rows, **sizes).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def prefix_column(n: F.Column) -> F.Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def keep_one(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns; of rows that repeat
    it one. Rows without an id or without words are in no group and stay."""
    whole, row = numbered(spark, documents)
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text")
    known = staged(spark, classes(spark, rows), "groups").where("n > 0 AND component IS NOT NULL")
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("size"))
    gone = join_groups(known, first, ["component"], "size", 1_000_000).where("row <> first.row").select(F.col("row").alias(row))
    return whole.join(gone.hint("merge"), row, "left_anti").select(*documents.columns)
