"""The pipeline: each stage's decisions made again by brute force, and odd tables through all stages."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as c
from tabulith.llm import common, decontaminate, toxicity
from tests.conftest import SMALL
from tests.llm.test_decontamination_brute import brute as leaks
from tests.llm.test_operators import ODD, brute_components, docs, normal


def packed(rows, texts):
    """Pieces cover every document's ids once, and windows are whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.array([*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.start == held.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        held[r.doc_id] = r.start + r.length
        assert held[r.doc_id] <= len(ids)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(0 < n <= 2048 and n & (n - 1) == 0 for n in ends.values())
    return {i for i in held if held[i] == max(r.doc_tokens for r in rows if r.doc_id == i)}


def test_run(spark):
    df, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect())
    texts = {r.doc_id: r.text for r in df.collect()}
    toxic = {r.doc_id for r in toxicity.score_documents(spark, df, labels).collect() if r.score >= 0.7}
    left = {i: t for i, t in texts.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(hashlib.sha256(normal(left[i]).encode()).hexdigest(), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, (n, k) in brute_components(list(left.items())).items() if i == k or not n}
    order = sorted(left)
    leaky = {order[n] for n, _ in leaks(items, [left[i] for i in order])}
    want = {i for i in order if i not in leaky}
    assert toxic and leaky and len(want) < len(texts) - len(toxic) - len(leaky)
    got = c.run(spark, SMALL).collect()
    assert packed(got, texts) == {r.doc_id for r in got} == want


def test_odd_tables(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = docs(spark, [*ODD, (60, "word " * 30_000), (60, "word " * 30_000)]).withColumn("row_", F.lit(1)).withColumn("Keep_", F.lit(None).cast("int"))
    for given in (rows, rows.limit(0)):
        left = common.staged(spark, given, "given")
        for name, stage in c.STAGES:
            left = stage(spark, left, str(tmp_path))
            if name != "packing":
                assert left.columns == rows.columns and left.schema.simpleString() == rows.schema.simpleString()
                left = common.staged(spark, left, name)
        got = left.collect()
        # Of equal texts the smallest id stays, white space alone is one blank and not empty; 7 and 60 are near copies, 4 also stands for the rows without an id.
        assert {r.doc_id for r in got} == ({1, 3, 4, 7, 8} if given is rows else set())


def test_no_labels_no_items(spark, tmp_path):
    df = docs(spark, ODD)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert c.toxicity_filter(spark, df, str(tmp_path)).count() == len(ODD)
    assert c.benchmark_leaks(spark, df, str(tmp_path)).count() == len(ODD)
    assert decontaminate.find_leaks(spark, df, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
