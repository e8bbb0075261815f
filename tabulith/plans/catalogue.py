"""The queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import labels as L
from tabulith.functions import missing as M
from tabulith.functions import temporal as D
from tabulith.operators import compress as C
from tabulith.operators.nulls import informative_nulls
from tabulith.plans import files
from tabulith.sources import dta, sas_script, sav, scan
from tabulith.sources.base import shared_folder

#: What values are taken modulo by, so that days and half-years from 1960 on end before the year 10,000.
DAYS, PERIODS = 1_000_000, 16_000
SEGMENTS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one in local mode."""
    return f"{shared_folder(spark, 'tabulith-files')}/{name}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, order_by: list[str], **options) -> DataFrame:
    """df through a .dta file and back."""
    path = scratch(spark, "table.dta")
    dta.write_dta(df, path, order_by=order_by)
    return scan.scan(spark, path, **options)


def lineitem(spark, sf_dir, columns=None, **options):
    return stored(spark, read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], columns=columns, **options)


def priced(df: DataFrame) -> DataFrame:
    return df.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.count("*").alias("n")
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_group_agg(spark, sf_dir)


def scan_group_agg(spark, sf_dir):
    return priced(lineitem(spark, sf_dir, ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"]))


def scan_dta_roundtrip(spark, sf_dir):
    got = stored(spark, read(spark, sf_dir, "customer"), ["c_custkey"])
    return scan.cast_known(got, {"c_custkey": "bigint", "c_nationkey": "int", "absent": "int"})


def scan_dta_part(spark, sf_dir):
    return scan.cast_known(stored(spark, read(spark, sf_dir, "part"), ["p_partkey"], partitions=3), {"p_partkey": "bigint", "p_size": "int"})


def scan_dta_datetime(spark, sf_dir):
    got = stored(spark, read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"])
    return got.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS").alias("ordered"))


def scan_projection_reorder(spark, sf_dir):
    got = stored(spark, read(spark, sf_dir, "nation"), ["n_nationkey"], columns=["n_regionkey", "n_name"])
    return scan.cast_known(got, {"n_regionkey": "int"})


def scan_offset_limit(spark, sf_dir):
    got = stored(spark, read(spark, sf_dir, "part"), ["p_partkey"], columns=["p_partkey", "p_name"], offset=17, limit=101, partitions=4)
    return scan.cast_known(got, {"p_partkey": "bigint"})


def scan_join(spark, sf_dir):
    nation = stored(spark, read(spark, sf_dir, "nation"), ["n_nationkey"])
    customer = stored(spark, read(spark, sf_dir, "customer"), ["c_custkey"], columns=["c_nationkey", "c_acctbal"])
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def scan_window(spark, sf_dir):
    from pyspark.sql import Window

    got = stored(spark, read(spark, sf_dir, "customer"), ["c_custkey"], columns=["c_custkey", "c_nationkey", "c_acctbal"])
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    got = got.withColumn("place", F.row_number().over(w)).where("place <= 3")
    return scan.cast_known(got, {"c_custkey": "bigint", "c_nationkey": "int"})


def batch_iter_counts(spark, sf_dir):
    got = stored(spark, read(spark, sf_dir, "part"), ["p_partkey"], columns=["p_partkey"], partitions=1)
    sizes = [(i, b.num_rows) for i, b in enumerate(scan.batches(got, 64))]
    return spark.createDataFrame(sizes, "batch int, n int")


def schema_cast(spark, sf_dir):
    return scan.cast_known(read(spark, sf_dir, "part").select("p_partkey", "p_size"), {"p_size": "double", "absent": "int"})


def empty_string_as_null(spark, sf_dir):
    made = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", M.blank_as_null(made).alias("segment"))


def decode_labels_int(spark, sf_dir):
    words = {v: k.title() for k, v in SEGMENTS.items() if v != 4}
    code = L.decode_label(F.col("c_mktsegment"), {k: str(v) for k, v in SEGMENTS.items()}, text=True).try_cast("int")
    return L.decode_labels(read(spark, sf_dir, "customer").select("c_custkey", code.alias("segment")), {"segment": words})


def decode_labels_string(spark, sf_dir):
    return L.decode_labels(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": {"F": "finished", "O": "open"}})


def decode_labels_float(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("double") / 2).alias("half"))
    return L.decode_labels(df, {"half": {0.5: "least", 25.0: "most"}})


def temporal_sas(spark, sf_dir):
    """As in the SQL, the value with its fraction is held against the bounds of dates."""
    c = F.col("l_orderkey").cast("double") + 0.25
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.sas_date(c, fractions=True).alias("as_date"), F.date_format(D.sas_datetime(c * 1000), "yyyy-MM-dd HH:mm:ss").alias("as_datetime"), D.sas_time(c).alias("as_time_us"))


def temporal_stata(spark, sf_dir):
    """Every order; the values of days and periods are dealt anew so that none leaves the calendar."""
    c = F.col("o_orderkey").cast("double")
    units = [D.stata_date(c % PERIODS, u).alias("as_" + u) for u in "mqh"]
    day = F.date_format(D.stata_datetime(c * 60_000), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.stata_date(c % DAYS).alias("as_d"), *units, day.alias("as_datetime"), D.stata_time(-c * 1000).alias("as_time_us"))


def temporal_spss(spark, sf_dir):
    """Every order; the values of days are dealt anew so that none leaves the calendar."""
    c = (F.col("o_orderkey") % DAYS).cast("double") * 86_400 + D.SPSS_SECONDS + 61
    day = F.date_format(D.spss_datetime(c), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.spss_date(c).alias("as_date"), day.alias("as_datetime"), D.spss_time(F.col("o_orderkey").cast("double")).alias("as_time_us"))


def stata_missing_byte(spark, sf_dir):
    c = F.col("l_partkey") % 128
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.stata_value(c, "byte").alias("v"), M.stata_tag(c, "byte").alias("tag"))


def spss_missing_range(spark, sf_dir):
    c = F.col("p_size").cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", M.spss_value(c, [50.0], (1.0, 5.0)).alias("v"), M.spss_tag(c, [50.0], (1.0, 5.0), {2.0: "two"}).alias("tag"))


def _tagged(spark, sf_dir, mode):
    c = F.col("p_size").cast("long") + 70
    df = read(spark, sf_dir, "part").select("p_partkey", c.alias("code"))
    df = df.withColumn("raw", F.col("code")).withColumn("code", M.stata_value(F.col("code"), "byte"))
    return informative_nulls(df, {"code": M.stata_tag(F.col("raw"), "byte")}, mode).drop("raw")


def inform_separate(spark, sf_dir):
    return _tagged(spark, sf_dir, "separate")


def inform_struct(spark, sf_dir):
    return _tagged(spark, sf_dir, "struct").select("p_partkey", F.col("code.code").alias("code"), F.col("code.null_indicator").alias("null_indicator"))


def inform_merged(spark, sf_dir):
    return _tagged(spark, sf_dir, "merged")


def compress_types(spark, sf_dir):
    """The type each column narrows to."""
    df = read(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_shipdate", (F.col("l_linenumber") % 2).alias("odd"), F.lit(None).cast("string").alias("none"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("digits"), "l_returnflag"
    )
    got = C.compress(df, C.CompressOptions(stata_bounds=True))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in got.schema.fields], "name string, type string")


def compress_values(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") % 2).alias("odd"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("digits"))
    got = C.compress(df, C.CompressOptions(cols=["l_quantity", "odd", "digits"]))
    return got.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), F.col("odd").cast("string").alias("odd"), F.col("digits").cast("int").alias("digits"))


def name_mangling(spark, sf_dir):
    from tabulith.formats.stata import stata_names

    given = ["ok", "1st", "for", "a b", "a_b", "x" * 40, "str12", "émile"]
    return spark.createDataFrame(list(zip(given, stata_names(given), strict=True)), "given string, made string")


def metadata_rows(spark, sf_dir):
    import json

    path = scratch(spark, "m.dta")
    dta.write_dta(read(spark, sf_dir, "nation"), path)
    got = json.loads(scan.metadata_json(path))
    return spark.createDataFrame([(v["name"], got["version"], got["row_count"], v["type"][:3]) for v in got["variables"]], "name string, version int, n int, kind string")


def stored_sav(spark: SparkSession, df: DataFrame, order_by: list[str], value_labels: dict | None = None, **options) -> DataFrame:
    """df through a .sav file and back."""
    path = scratch(spark, "table.sav")
    sav.write_sav(df, path, value_labels, order_by=order_by)
    return scan.scan(spark, path, **options)


def scan_sav_roundtrip(spark, sf_dir):
    got = stored_sav(spark, read(spark, sf_dir, "customer"), ["c_custkey"])
    return scan.cast_known(got, {"c_custkey": "bigint", "c_nationkey": "int"})


def scan_sav_group_agg(spark, sf_dir):
    wanted = ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"]
    return priced(stored_sav(spark, read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], columns=wanted))


def scan_sav_labels(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    got = stored_sav(spark, df, ["p_partkey"], {"p_size": {1: "least", 50: "most"}}, labels=True)
    return scan.cast_known(got, {"p_partkey": "bigint"})


def sas_script_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    sas_script.sas_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("o_orderkey bigint, o_orderdate bigint").csv(path)


STATA_CODE = "CASE WHEN c >= 102 AND c <= 127 THEN '.' || chr(CAST(c - 101 + 96 AS INTEGER)) END"
TAGGED = "FROM (SELECT p_partkey, CAST(p_size AS BIGINT) + 70 AS c FROM part)"
ORACLES = {
    "scan_group_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "scan_dta_roundtrip": "SELECT * FROM customer",
    "scan_sav_roundtrip": "SELECT * FROM customer",
    "scan_dta_part": "SELECT * FROM part",
    "scan_dta_datetime": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS ordered FROM orders",
    "scan_projection_reorder": "SELECT n_regionkey, n_name FROM nation",
    "scan_offset_limit": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 101 OFFSET 17",
    "scan_join": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "scan_window": "SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer) WHERE place <= 3",
    "batch_iter_counts": "SELECT CAST(k AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS k FROM part) GROUP BY 1",
    "schema_cast": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part",
    "empty_string_as_null": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer",
    "decode_labels_int": "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile' WHEN 'BUILDING' THEN 'Building' WHEN 'FURNITURE' THEN 'Furniture' WHEN 'HOUSEHOLD' THEN '4' WHEN 'MACHINERY' THEN 'Machinery' END AS segment FROM customer",
    "decode_labels_string": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "temporal_sas": "SELECT l_orderkey, l_linenumber, CAST(DATE '1960-01-01' + CAST(CASE WHEN l_orderkey + 0.25 <= 160588 THEN l_orderkey ELSE l_orderkey // 86400 END AS INTEGER) AS DATE) AS as_date, strftime(TIMESTAMP '1960-01-01' + to_seconds(l_orderkey * 1000 + 250), '%Y-%m-%d %H:%M:%S') AS as_datetime, l_orderkey * 1000000 + 250000 AS as_time_us FROM lineitem",
    "stata_missing_byte": f"SELECT l_orderkey, l_linenumber, CASE WHEN c < 101 THEN c END AS v, {STATA_CODE} AS tag FROM (SELECT l_orderkey, l_linenumber, l_partkey % 128 AS c FROM lineitem)",
    "spss_missing_range": "SELECT p_partkey, CASE WHEN p_size = 50 OR p_size BETWEEN 1 AND 5 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_size = 2 THEN 'two' WHEN p_size = 50 THEN '50' WHEN p_size BETWEEN 1 AND 5 THEN 'MISSING' END AS tag FROM part",
    "inform_separate": f"SELECT p_partkey, CASE WHEN c < 101 THEN c END AS code, {STATA_CODE} AS code_null {TAGGED}",
    "inform_struct": f"SELECT p_partkey, CASE WHEN c < 101 THEN c END AS code, {STATA_CODE} AS null_indicator {TAGGED}",
    "inform_merged": f"SELECT p_partkey, CASE WHEN c < 101 THEN CAST(c AS VARCHAR) ELSE {STATA_CODE} END AS code {TAGGED}",
    "compress_types": "SELECT * FROM (VALUES ('l_linenumber', 'tinyint'), ('l_quantity', 'tinyint'), ('l_discount', 'double'), ('l_shipdate', 'date'), ('odd', 'boolean'), ('none', 'boolean'), ('digits', 'tinyint'), ('l_returnflag', 'string')) AS t(name, type)",
    "compress_values": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, CASE WHEN l_linenumber % 2 = 1 THEN 'true' ELSE 'false' END AS odd, l_linenumber AS digits FROM lineitem",
    "name_mangling": "SELECT * FROM (VALUES ('ok', 'ok'), ('1st', '_1st'), ('for', '_for'), ('a b', 'a_b'), ('a_b', '_0a_b'), (repeat('x', 40), repeat('x', 32)), ('str12', '_str12'), ('émile', '_mile')) AS t(given, made)",
    "metadata_rows": "SELECT * FROM (VALUES ('n_nationkey', 118, 25, 'byt'), ('n_name', 118, 25, 'str'), ('n_regionkey', 118, 25, 'byt')) AS t(name, version, n, kind)",
    "sas_script_csv": "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 315619200 AS o_orderdate FROM orders",
    "scan_sav_labels": "SELECT p_partkey, CASE p_size WHEN 1 THEN 'least' WHEN 50 THEN 'most' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part",
    "decode_labels_float": "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'least' WHEN p_size = 50 THEN 'most' WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS half FROM part",
    "temporal_stata": f"SELECT o_orderkey, CAST(DATE '1960-01-01' + CAST(o_orderkey % {DAYS} AS INTEGER) AS DATE) AS as_d, CAST(DATE '1960-01-01' + to_months(CAST(n AS INTEGER)) AS DATE) AS as_m, CAST(DATE '1960-01-01' + to_months(CAST(n * 3 AS INTEGER)) AS DATE) AS as_q, CAST(DATE '1960-01-01' + to_months(CAST(n * 6 AS INTEGER)) AS DATE) AS as_h, strftime(TIMESTAMP '1960-01-01' + to_minutes(o_orderkey), '%Y-%m-%d %H:%M:%S') AS as_datetime, ((86400000 - (o_orderkey * 1000) % 86400000) % 86400000) * 1000 AS as_time_us FROM (SELECT o_orderkey, o_orderkey % {PERIODS} AS n FROM orders)",
    "temporal_spss": f"SELECT o_orderkey, CAST(DATE '1970-01-01' + CAST(o_orderkey % {DAYS} AS INTEGER) AS DATE) AS as_date, strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey % {DAYS} * 86400 + 61), '%Y-%m-%d %H:%M:%S') AS as_datetime, o_orderkey * 1000000 AS as_time_us FROM orders",
}
ORACLES["scan_sav_group_agg"] = ORACLES["scan_group_agg"]


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES} | files.queries()


def oracle_sql() -> dict[str, str]:
    return ORACLES | files.ORACLES
