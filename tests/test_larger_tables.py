"""Queries and operators where tables outgrow the small ones: Spark's batches and partitions, keys past a bound."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.functions import temporal as D
from tabulith.plans import catalogue
from tabulith.sources import sas7bdat, scan


def from_sql(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())


@pytest.fixture
def hundred(spark):
    """Spark's own batches have 100 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "100")
    yield
    spark.conf.unset(key)


def test_batch_iter_counts(spark, tmp_path, hundred):
    spark.range(1000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalogue.batch_iter_counts(spark, str(tmp_path)).collect())
    assert got == from_sql("batch_iter_counts", part=f"{tmp_path}/part.parquet")
    assert [n for _, n in got] == [64] * 15 + [40]


@pytest.mark.parametrize("size", [1, 64, 100, 250, 1000, 1001])
def test_batches_across_partitions(spark, hundred, size):
    got = list(scan.batches(spark.range(0, 1000, 1, 7), size))
    assert [b.num_rows for b in got] == [size] * (1000 // size) + [1000 % size] * (1000 % size > 0)
    assert [x for b in got for x in b["id"].to_pylist()] == list(range(1000))


def test_batches_of_nothing(spark):
    assert list(scan.batches(spark.range(0), 3)) == []
    with pytest.raises(ValueError, match="one row"):
        next(scan.batches(spark.range(5), 0))


def test_temporal_sas(spark, tmp_path):
    """Keys beside the last day, and past the year 2255, where datetimes were null."""
    keys = [0, 86_400, 160_586, 160_587, 160_588, 160_589, 172_800, 9_315_618, 9_315_620, 150_000_000]
    spark.createDataFrame([(k, i) for k in keys for i in (1, 2)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in catalogue.temporal_sas(spark, str(tmp_path)).collect())
    assert got == from_sql("temporal_sas", lineitem=f"{tmp_path}/lineitem.parquet")
    assert {r[2] for r in got if r[0] == 160_588} == {dt.date(1960, 1, 2)} and all(r[3] for r in got)


def test_sas_values_as_a_scan_has_them(spark):
    """Without `fractions` whole days are held against the bounds, in expressions as in scans."""
    x = [0.0, -0.5, 160_587.5, 160_588.0, 160_588.25, 160_589.0, -131_427.0, -131_427.5, -131_428.0, 9.4e9, -9.4e9, 2.5e11]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    v, epoch = F.col("v"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, D.sas_datetime(v))
    got = df.orderBy("i").select(F.datediff(D.sas_date(v), F.lit("1970-01-01").cast("date")), micros, D.sas_time(v)).collect()
    kinds = {"date": "int32", "datetime": "int64", "time": "int64"}
    want = [sas7bdat.temporal_array(np.array(x), np.ones(len(x), bool), k).view(t).to_pylist() for k, t in kinds.items()]
    seen = [k for k, d in enumerate(want[0]) if d is not None]  # a scan has no date beyond the calendar
    assert [got[k][0] for k in seen] == [want[0][k] for k in seen] and got[4][0] == D.SAS_MOST
    assert [r[1] for r in got] == want[1] and [r[2] for r in got] == want[2]
