"""Queries over files of the three formats: what a table is after it was written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.formats.sas_write import Layout
from tabulith.sources import dta, sas7bdat, sav, scan
from tabulith.sources.base import shared_folder

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
WANTED = ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"]
#: The number that a tagged column's row has, by the storage type.
KINDS = {"byte": "tinyint", "int": "smallint", "long": "int", "float": "float", "double": "double"}


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark, 'tabulith-files')}/{name}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_sas(spark, df, order_by=None, layout=None, tags=None, **options) -> DataFrame:
    path = scratch(spark, "table.sas7bdat")
    sas7bdat.write_sas7bdat(df, path, layout, order_by, tags=tags)
    return scan.scan(spark, path, **options)


def as_dta(spark, df, order_by=None, **given) -> str:
    path = scratch(spark, "table.dta")
    dta.write_dta(df, path, order_by=order_by, **given)
    return path


def scan_sas_roundtrip(spark, sf_dir):
    return scan.cast_known(as_sas(spark, read(spark, sf_dir, "customer"), ["c_custkey"]), {"c_custkey": "bigint", "c_nationkey": "int"})


def scan_sas_group_agg(spark, sf_dir):
    got = as_sas(spark, read(spark, sf_dir, "lineitem"), LINES, columns=WANTED)
    return got.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.count("*").alias("n")
    )


def _packed(spark, sf_dir, layout):
    return scan.cast_known(as_sas(spark, read(spark, sf_dir, "part"), ["p_partkey"], layout, partitions=3), {"p_partkey": "bigint", "p_size": "int"})


def scan_sas_rle(spark, sf_dir):
    return _packed(spark, sf_dir, Layout(compression="rle", page=8192))


def scan_sas_rdc_big_endian(spark, sf_dir):
    return _packed(spark, sf_dir, Layout(False, ">", "rdc", page=8192, late_formats=True))


def scan_sas_offset_limit(spark, sf_dir):
    """Offset and limit are the feature: they count over pages of a compressed file."""
    got = as_sas(spark, read(spark, sf_dir, "part"), ["p_partkey"], Layout(compression="rle", page=4096), columns=["p_name", "p_partkey"], offset=50, limit=77, partitions=4)
    return scan.cast_known(got, {"p_partkey": "bigint"})


def scan_sas_datetime(spark, sf_dir):
    got = as_sas(spark, read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"])
    return got.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS").alias("ordered"))


def sas_missing_tags(spark, sf_dir):
    size = F.col("p_size")
    tag = F.when(size % 4 == 0, ".A").when(size % 4 == 1, "._").when(size % 4 == 2, ".Z")
    df = read(spark, sf_dir, "part").select("p_partkey", F.when(size % 5 > 0, size.cast("double")).alias("code"), tag.alias("why"))
    return scan.cast_known(as_sas(spark, df, ["p_partkey"], tags={"code": "why"}, indicators="_null", indicator_columns=["code"]), {"p_partkey": "bigint"})


def _tagged(spark, sf_dir, kind, **options):
    size = F.col("p_size")
    tag = F.when(size % 3 > 0, F.concat(F.lit("."), F.char((97 + size % 26).cast("int"))))
    df = read(spark, sf_dir, "part").select("p_partkey", F.when(size % 5 > 0, size).cast(KINDS[kind]).alias("code"), tag.alias("why"))
    # The least and largest value decide the storage type of integers; one row more makes it the wanted one.
    most = {"byte": 100, "int": 32740, "long": 2147483620}.get(kind, 0)
    df = df.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("p_partkey"), F.lit(most).cast(KINDS[kind]).alias("code"), F.lit(None).cast("string").alias("why")))
    path = as_dta(spark, df, ["p_partkey"], tags={"code": "why"})
    got = scan.scan(spark, path, offset=1, indicators="_null", indicator_columns=["code"], **options)
    return scan.cast_known(got, {"p_partkey": "bigint"} | ({} if options else {"code": "double"}))


def stata_tags_byte(spark, sf_dir):
    return _tagged(spark, sf_dir, "byte")


def stata_tags_int(spark, sf_dir):
    return _tagged(spark, sf_dir, "int")


def stata_tags_long(spark, sf_dir):
    return _tagged(spark, sf_dir, "long")


def stata_tags_float(spark, sf_dir):
    return _tagged(spark, sf_dir, "float")


def stata_tags_double(spark, sf_dir):
    return _tagged(spark, sf_dir, "double")


def scan_inform_merged(spark, sf_dir):
    return _tagged(spark, sf_dir, "int", indicator_mode="merged").select("p_partkey", "code")


def scan_inform_struct(spark, sf_dir):
    return _tagged(spark, sf_dir, "double", indicator_mode="struct").select("p_partkey", F.col("code.code").alias("code"), F.col("code.null_indicator").alias("code_null"))


def stata_strl_roundtrip(spark, sf_dir):
    path = as_dta(spark, read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ")).alias("text")), ["doc_id"])
    return scan.cast_known(scan.scan(spark, path, empty_as_null=False, partitions=4), {"doc_id": "bigint"})


def stata_labels(spark, sf_dir):
    words = {1: "least", 50: "most", 7: "sieben – 七"}
    path = as_dta(spark, read(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], value_labels={"p_size": words})
    return scan.cast_known(scan.scan(spark, path, labels=True), {"p_partkey": "bigint"})


def stata_periods(spark, sf_dir):
    n = F.col("o_orderkey") % 16_000
    df = read(spark, sf_dir, "orders").select("o_orderkey", *((n if u != "y" else 1960 + n % 8000).alias(u) for u in "wmqhy"))
    got = scan.scan(spark, as_dta(spark, df, ["o_orderkey"], formats={u: "%t" + u for u in "wmqhy"}))
    return scan.cast_known(got, {"o_orderkey": "bigint"})


def stata_batches(spark, sf_dir):
    """Through Arrow batches of one process, without the number of rows."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy("p_partkey")
    width = df.agg(F.max(F.octet_length("p_name"))).first()[0] or 1
    folder = shared_folder(spark, "tabulith-files")
    path = f"{folder.removeprefix('file://')}/batches.dta"
    dta.write_batches(path, dta.batch_schema(df.schema, {"p_name": width}), scan.batches(df, 1000))
    return scan.cast_known(scan.scan(spark, path), {"p_partkey": "bigint"})


def scan_filter_pushdown(spark, sf_dir):
    path = as_dta(spark, read(spark, sf_dir, "lineitem"), LINES)
    wanted = lambda df: df.where("l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 2).alias("tax"))
    return scan.pruned(spark, path, wanted)


def scan_set_ops(spark, sf_dir):
    nation = scan.scan(spark, as_dta(spark, read(spark, sf_dir, "nation"), ["n_nationkey"]))
    customer = scan.scan(spark, as_dta(spark, read(spark, sf_dir, "customer"), ["c_custkey"]), columns=["c_nationkey", "c_acctbal"])
    keys, rich, poor = nation.select("n_nationkey"), customer.where("c_acctbal > 9000").select("c_nationkey"), customer.where("c_acctbal < -900").select("c_nationkey")
    made = [("neither", keys.exceptAll(rich.union(poor).distinct())), ("both", rich.intersect(poor)), ("any", rich.union(poor).distinct())]
    parts = [df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("int").alias("nation")) for name, df in made]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scan_rollup(spark, sf_dir):
    got = as_sas(spark, read(spark, sf_dir, "customer"), ["c_custkey"], columns=["c_mktsegment", "c_nationkey", "c_acctbal"])
    got = got.rollup("c_mktsegment", F.col("c_nationkey").cast("int").alias("nation")).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return got.select("c_mktsegment", "nation", F.col("level").cast("int").alias("level"), "n", "balance")


def scan_sort(spark, sf_dir):
    """The top 20, which is the feature; both files are SPSS ones."""
    path = scratch(spark, "table.sav")
    sav.write_sav(read(spark, sf_dir, "customer"), path, order_by=["c_custkey"])
    got = scan.scan(spark, path, columns=["c_name", "c_acctbal"]).orderBy(F.desc("c_acctbal"), "c_name").limit(20)
    return got.withColumnRenamed("c_acctbal", "balance")


def scan_vstack(spark, sf_dir):
    """One file in two scans, put together again."""
    df = read(spark, sf_dir, "supplier")
    path, half = as_dta(spark, df, ["s_suppkey"]), df.count() // 2
    got = scan.scan(spark, path, limit=half).unionByName(scan.scan(spark, path, offset=half))
    return scan.cast_known(got, {"s_suppkey": "bigint", "s_nationkey": "int"})


def read_builder(spark, sf_dir):
    path = as_dta(spark, read(spark, sf_dir, "part"), ["p_partkey"])
    return scan.ReadBuilder(spark, path).columns(["p_size", "p_partkey"]).filters([("p_size", "<=", 10)]).threads(3).cast({"p_partkey": "bigint", "p_size": "double", "absent": "int"}).finish()


def _metadata(spark, path, names, shape):
    got = spark.createDataFrame([(scan.metadata_json(path),)], "j string").select(F.from_json("j", f"row_count bigint, compression string, {names} array<struct<{shape}>>").alias("m"))
    return got.select(F.col("m.row_count").alias("n"), F.col("m.compression").alias("compression"), F.explode(f"m.{names}").alias("v"))


def metadata_sas(spark, sf_dir):
    path = scratch(spark, "m.sas7bdat")
    sas7bdat.write_sas7bdat(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), path, Layout(compression="rdc"))
    return _metadata(spark, path, "columns", "name string, type string, format string, length int").select("n", "compression", "v.name", "v.type", "v.format", "v.length")


def metadata_spss(spark, sf_dir):
    path = scratch(spark, "m.sav")
    sav.write_sav(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), path)
    return _metadata(spark, path, "variables", "name string, type string, format_class string, string_len int").select("n", "compression", "v.name", "v.type", "v.format_class", "v.string_len")


def stata_files(spark, sf_dir):
    """The files of a folder as a stream: every file once, whatever the number of micro-batches."""
    from tabulith.streaming import folder

    top = shared_folder(spark, "tabulith-stream")
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    for k in range(3):
        dta.write_dta(df.where(F.col("c_custkey") % 3 == k).withColumn("c_custkey", F.col("c_custkey").cast("double")), f"{top}/part{k}.dta")
    got = folder.stream_folder(spark, top, "dta").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    name = "stata_files_" + top.rpartition("-")[2]
    got.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{top}-state").trigger(availableNow=True).start().awaitTermination()
    return scan.cast_known(spark.table(name), {"c_nationkey": "int"})


TAGS = "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS code, CASE WHEN p_size % 5 = 0 AND p_size % 3 > 0 THEN '.' || chr(CAST(97 + p_size % 26 AS INTEGER)) END AS code_null FROM part"
ORACLES = {
    "scan_sas_roundtrip": "SELECT * FROM customer",
    "scan_sas_group_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "scan_sas_rle": "SELECT * FROM part",
    "scan_sas_rdc_big_endian": "SELECT * FROM part",
    "scan_sas_offset_limit": "SELECT p_name, p_partkey FROM part ORDER BY p_partkey LIMIT 77 OFFSET 50",
    "scan_sas_datetime": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS ordered FROM orders",
    "sas_missing_tags": "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS code, CASE WHEN p_size % 5 = 0 THEN CASE p_size % 4 WHEN 0 THEN '.A' WHEN 1 THEN '._' WHEN 2 THEN '.Z' END END AS code_null FROM part",
    **{f"stata_tags_{k}": TAGS for k in KINDS},
    "scan_inform_struct": TAGS,
    "scan_inform_merged": f"SELECT p_partkey, coalesce(CAST(CAST(code AS INTEGER) AS VARCHAR), code_null) AS code FROM ({TAGS})",
    "stata_strl_roundtrip": "SELECT doc_id, coalesce(text || ' ', '') AS text FROM documents",
    "stata_labels": "SELECT p_partkey, CASE p_size WHEN 1 THEN 'least' WHEN 50 THEN 'most' WHEN 7 THEN 'sieben – 七' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part",
    "stata_periods": "SELECT o_orderkey, CAST(make_date(CAST(1960 + n // 52 AS BIGINT), 1, 1) + CAST(n % 52 * 7 AS INTEGER) AS DATE) AS w, CAST(DATE '1960-01-01' + to_months(CAST(n AS INTEGER)) AS DATE) AS m, CAST(DATE '1960-01-01' + to_months(CAST(n * 3 AS INTEGER)) AS DATE) AS q, CAST(DATE '1960-01-01' + to_months(CAST(n * 6 AS INTEGER)) AS DATE) AS h, make_date(1960 + n % 8000, 1, 1) AS y FROM (SELECT o_orderkey, o_orderkey % 16000 AS n FROM orders)",
    "stata_batches": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "scan_filter_pushdown": "SELECT l_linestatus, count(*) AS n, round(sum(l_tax), 2) AS tax FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1",
    "scan_set_ops": "WITH rich AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), poor AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < -900) SELECT 'neither' AS part, n_nationkey AS nation FROM nation WHERE n_nationkey NOT IN (SELECT k FROM rich UNION SELECT k FROM poor) UNION ALL SELECT 'both', k FROM (SELECT k FROM rich INTERSECT SELECT k FROM poor) UNION ALL SELECT 'any', k FROM (SELECT k FROM rich UNION SELECT k FROM poor)",
    "scan_rollup": "SELECT c_mktsegment, c_nationkey AS nation, CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS INTEGER) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "scan_sort": "SELECT c_name, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20",
    "scan_vstack": "SELECT * FROM supplier",
    "read_builder": "SELECT CAST(p_size AS DOUBLE) AS p_size, p_partkey FROM part WHERE p_size <= 10",
    "metadata_sas": "SELECT (SELECT count(*) FROM orders) AS n, 'Rdc' AS compression, * FROM (VALUES ('o_orderkey', 'Numeric', NULL, 8), ('o_orderstatus', 'Character', NULL, (SELECT CAST(max(strlen(o_orderstatus)) AS INTEGER) FROM orders)), ('o_orderdate', 'Numeric', 'DATETIME22.3', 8)) AS t(name, type, format, length)",
    "metadata_spss": "SELECT (SELECT count(*) FROM orders) AS n, 'None' AS compression, * FROM (VALUES ('o_orderkey', 'Numeric', NULL, 0), ('o_orderstatus', 'Str', NULL, (SELECT CAST(max(strlen(o_orderstatus)) AS INTEGER) FROM orders)), ('o_orderdate', 'Numeric', 'DateTime', 0)) AS t(name, type, format_class, string_len)",
    "stata_files": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES}
