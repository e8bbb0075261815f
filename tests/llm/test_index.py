"""The persistent digest index: places, buckets, and batches that are run again."""

import pytest

from tabulith.llm import exact_dedup
from tests.llm.test_operators import docs


def run(spark, rows, path):
    return sorted(tuple(r) for r in exact_dedup.exact_dedup(spark, docs(spark, rows), path).select("doc_id", "keep_id", "group_size", "kept").collect())


def test_same_name_in_two_folders(spark, tmp_path):
    one, two = f"{tmp_path}/a/index", f"{tmp_path}/b/index"
    run(spark, [(1, "x"), (2, "y")], one)
    assert run(spark, [(3, "x")], two) == [(3, 3, 1, True)]
    assert (tmp_path / "b" / "index" / "data").exists()
    assert run(spark, [(4, "y")], f"{tmp_path}/a/../a/index/".replace("/../a", "")) == [(4, 2, 1, False)]


def test_buckets_are_those_of_the_index(spark, tmp_path):
    path, rows = f"{tmp_path}/index", [(k, f"text {k}") for k in range(200)]
    exact_dedup.assign(spark, _keyed(spark, rows), exact_dedup.DigestIndex(spark, path, 4)).count()
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert exact_dedup.DigestIndex(spark, path).buckets == 4
        again = run(spark, [(1000 + k, t) for k, t in rows], path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert again == [(1000 + k, k, 1, False) for k in range(200)]
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 2)


def _keyed(spark, rows):
    from pyspark.sql import functions as F

    return docs(spark, rows, extra=False).select("doc_id", F.unhex(exact_dedup.digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))


def test_a_batch_run_again_gets_the_same_answers(spark, tmp_path):
    path = f"{tmp_path}/index"
    first, second = [(k, f"t {k % 150}") for k in range(200)], [(500 + k, f"t {100 + k}") for k in range(100)]
    one, two = run(spark, first, path), run(spark, second, path)
    assert sum(r[3] for r in one) == 150 and sum(r[3] for r in two) == 50
    assert run(spark, first[::-1], path) == one and run(spark, second, path) == two
    assert exact_dedup.DigestIndex(spark, path).read().count() == 200
    assert run(spark, [], path) == []


def test_rows_that_repeat(spark, tmp_path):
    rows = [(3, "a"), (3, "a"), (3, "b"), (None, "a"), (None, "c"), (None, "c"), (2, "a ")]
    got = run(spark, [r for r in rows if r[0] is not None], f"{tmp_path}/i")
    assert got == [(2, 2, 1, True), (3, 3, 1, True), (3, 3, 2, False), (3, 3, 2, True)]
    left = exact_dedup.drop_copies(spark, docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == [(False, 2, "a "), (False, 3, "a"), (False, 3, "b"), (True, 0, "c")]
