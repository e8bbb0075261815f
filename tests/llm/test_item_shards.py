"""Scores and leaks do not depend on the number of shards the items are broadcast in."""

from tabulith.llm import decontaminate as d
from tests.conftest import SMALL


def test_shards_score_alike(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    # A document that holds about half of an item scores between 0 and 1.
    texts = [r.text.split(" ") for r in items.orderBy("item_id").limit(40).collect()]
    half = spark.createDataFrame([(10_000 + k, " ".join(w[: len(w) - len(w) // 6])) for k, w in enumerate(texts)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(half)
    one = sorted(map(tuple, d.find_leaks(spark, docs, items).select("doc_id", "item_id", "score").collect()))
    size = sum(len(r.text.encode()) for r in items.collect())
    monkeypatch.setattr(d, "SHARD_BYTES", size // 5)
    many = sorted(map(tuple, d.find_leaks(spark, docs, items).select("doc_id", "item_id", "score").collect()))
    assert any(s < 0.99 for *_, s in one)
    assert [r[:2] for r in one] == [r[:2] for r in many] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(one, many))
