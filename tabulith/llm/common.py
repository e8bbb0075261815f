"""Shared pieces of the training-data operators: staging, column names, words, hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tabulith-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/tabulith-{sc.applicationId}"
    if getattr(sc, "_tabulith_dir", None) != top:
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(top)
        system = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        sc._tabulith_dir, sc._tabulith_paths = top, []
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    sc._tabulith_paths.append(path)
    return path


def made_paths(spark: SparkSession) -> list[str]:
    """The paths given out so far and not dropped."""
    return list(getattr(spark.sparkContext, "_tabulith_paths", ()))


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what was written at these paths: nothing may read them any more."""
    sc = spark.sparkContext
    for path in paths:
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
        sc._tabulith_paths.remove(path)


def numbered(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, str]:
    """documents, written once with a number that tells every row, equal ones too; and that column's name."""
    (row,) = fresh(documents, "row_")
    return staged(spark, documents.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that do not clash with those of df (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def id_text(documents: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty: what other columns are called does not matter."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system: idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves its worker small when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_groups(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for applyInArrow, with (key, table) or (key, left, right); for large groups, as it runs after each."""

    def one(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        try:
            return run(key, left)
        finally:
            give_back()

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(key, left, right)
        finally:
            give_back()

    return one if run.__code__.co_argcount == 2 else two


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Maps a word (bytes) to a stable 64-bit hash; forgets all when it grows past `most`."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.hash(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text: A-Z lowered, cut at ASCII white space only."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; one for fewer words; empty for none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        acc = np.full(1, 0x9E3779B97F4A7C15 + n, np.uint64)
        for k in range(n):
            acc = mix64(acc * np.uint64(3) + h[k : k + 1])
        return acc
    acc = np.full(n - width + 1, 0x51ED270B, np.uint64)
    for k in range(width):
        acc = mix64(acc * np.uint64(3) + h[k : n - width + 1 + k])
    return np.unique(acc)


def package_zip(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters that lack it."""
    import zipfile

    import tabulith

    sc = spark.sparkContext
    if getattr(sc, "_tabulith_sent", False):
        return
    root = os.path.dirname(os.path.abspath(tabulith.__file__))
    folder = tempfile.mkdtemp(prefix="tabulith-code-")
    path = os.path.join(folder, "tabulith.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("tabulith", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tabulith_sent = True


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: float = 0.001) -> DataFrame:
    """rows joined with the one row their group has in `groups`; groups with many rows do not meet in one task.

    A group is hot from `share` of all rows on: there are at most 1 / share of them, and only
    those are broadcast. The rest go through a sort-merge join.
    """
    hot = F.col(size) >= max(2, int(total * share))
    big = F.broadcast(groups.where(hot))
    flag = F.broadcast(groups.where(hot).select(*keys))
    return rows.join(big, keys).unionByName(rows.join(flag, keys, "left_anti").join(groups.where(~hot).hint("merge"), keys))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b). Labels spread and are shortened
    by their own labels in turn; every round is written to the shared folder. The labels of nodes with
    a thousandth of all links are broadcast, so that a star's middle is not one task's work."""
    edges = staged(spark, links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    total = edges.count()
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("degree"))
    labels = staged(spark, labels, "labels")
    while total:
        seen = join_groups(edges, labels.withColumnRenamed("node", "b"), ["b"], "degree", max(total, 1_000_000)).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = staged(spark, labels.join(seen, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("to")), "labels")
        # A label is the node of a whole component, so it is counted before it is looked up.
        jump = near.groupBy("to").agg(F.count("*").alias("held")).join(labels.select(F.col("node").alias("to"), F.col("label").alias("far")), "to")
        new = join_groups(near, jump, ["to"], "held", max(total, 1_000_000)).select("node", "degree", "old", F.least("to", "far").alias("label"))
        new = staged(spark, new, "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label", "degree")
        if not moved:
            break
    return labels.select("node", "label")
