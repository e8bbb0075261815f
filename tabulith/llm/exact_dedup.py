"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

A document's digest is the SHA-256 of its text with every run of ASCII white space made one
space (null text counts as empty). New data is grouped by digest (partial aggregation, so a
group of copies of any size is one row per task before the shuffle), taken against the index
by a sort-merge anti-join, and what is new is appended. The index answers later batches.

An index is a folder: `data` holds the bucketed files, `layout` the number of buckets, which any
session that opens it takes from there. Every entry says which batch brought it, and a batch is
told by its digests and ids, so one that is run again, after a failure say, gets the answers of
the first time and adds nothing. One writer at a time is assumed.

Defined results: null text equals empty text; rows with a null doc_id sort after all others and
stay only if no row of their group has an id; of rows that repeat a doc_id and text one stays;
ties are thus decided by doc_id and then by the row's place; texts of any length are read whole;
empty tables give an empty result; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import SPACE, drop_paths, fresh_path, id_text, join_groups, made_paths, numbered, shuffle_width, staged


def digest(text) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


class DigestIndex:
    """A table (digest, keep_id, batch) below `path`, clustered and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = system.makeQualified(hadoop).toString()
        layout = f"{self.path}/layout"
        if not system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(layout)):
            made = buckets or shuffle_width(spark)
            spark.createDataFrame([(made,)], "buckets int").coalesce(1).write.parquet(layout)
        self.buckets = spark.read.schema("buckets int").parquet(layout).first()[0]
        if buckets and buckets != self.buckets:
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: int) -> None:
        """Appends the groups whose digest the index lacks: sort-merge anti-join, then insert."""
        have = self.read().select("digest").hint("merge")
        groups.join(have, "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)


    def drop(self) -> None:
        """Forgets the table and deletes its files: for an index that answers one batch only."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_paths(self.spark, [p for p in made_paths(self.spark) if self.path.endswith(p.split("://")[-1])])


def assign(spark: SparkSession, rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of `rows` (doc_id, digest, row), with the group it falls in; new digests are
    appended to the index.

    kept is true for the row that stays: the one with the smallest doc_id of a group whose digest
    the index did not hold before this batch.
    """
    keyed = staged(spark, rows, "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = staged(spark, keyed.groupBy("digest").agg(first, F.count("*").alias("group_size")), "digest-groups")
    # The sum of hashes tells the batch whatever the order of its rows.
    told = groups.agg(F.coalesce(F.expr("try_sum(cast(xxhash64(digest, first.none, first.doc_id, group_size) as decimal(38,0)))"), F.lit(0)).alias("h"), F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    batch = int.from_bytes(hashlib.sha256(repr(tuple(map(int, told))).encode()).digest()[:8], "big", signed=True)
    old = index.read().select("digest", F.col("keep_id").alias("old_id"), (F.col("batch") != batch).alias("known"))
    groups = groups.join(old.hint("merge"), "digest", "left").select(
        "digest",
        "group_size",
        F.when(F.col("known"), F.col("old_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.when(F.col("known"), F.lit(None)).otherwise(F.col("first.row")).alias("keep_row"),
    )
    groups = staged(spark, groups, "digest-decided")
    index.append(groups, batch)

    joined = join_groups(keyed, groups, ["digest"], "group_size", int(told[2]))
    return joined.select("doc_id", "row", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def over(spark: SparkSession, rows: DataFrame, index_path: str | None) -> DataFrame:
    """assign() over the index at index_path, or over a new one that goes when the groups are decided and written."""
    index = DigestIndex(spark, index_path or fresh_path(spark, "digest_index"))
    out = assign(spark, rows, index)
    if index_path is None:
        index.drop()
    return out


def exact_dedup(spark: SparkSession, documents: DataFrame, index_path: str | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept and text_sha256."""
    rows = id_text(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return over(spark, rows, index_path).drop("row")


def drop_copies(spark: SparkSession, documents: DataFrame, index_path: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are numbered once and written; digests are taken from there, and whole rows are moved once,
    by their number, which no two share.
    """
    whole, row = numbered(spark, documents)
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(F.col("text"))).alias("digest"), F.col(row).alias("row"))
    kept = over(spark, rows, index_path).where("kept").select(F.col("row").alias(row))
    return whole.join(kept.hint("merge"), row, "left_semi").select(*documents.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
