"""Packing: what the heaviest terms find of the best neighbours, balance of parts, odd texts."""

import numpy as np
import pytest

from tabulith.llm import packing as P
from tests.conftest import SMALL
from tests.llm.test_operators import docs


@pytest.fixture(scope="module")
def shard(spark):
    top = SMALL.replace("0.001", "0.01")
    tok = P.Tokenizer()
    texts = [r.text or "" for r in spark.read.parquet(f"{top}/documents.parquet").collect()]
    ids = [np.frombuffer(b + b"\1\0", np.uint16) for b in tok.encode_all(texts)]
    df = np.zeros(P.VOCABULARY, np.int64)
    for d in ids:
        df[np.unique(d)] += 1
    return P.Shard(ids, np.log(1 + (len(ids) - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in ids])))


def test_recall_of_the_best_neighbours(shard):
    """Against BM25 with all terms of the seed, over all documents of the shard."""
    found = []
    for seed in range(0, shard.n, 7):
        unused = np.ones(shard.n, bool)
        unused[seed] = False
        exact = shard.scores(seed)
        exact[seed] = -1
        best = exact[np.argsort(-exact, kind="stable")[:8]]
        got = [d for d, _ in zip(shard.neighbours(seed, unused), range(8))]
        found.append(np.mean(exact[got] >= best[-1] - 1e-4))
    assert np.mean(found) >= 0.95


def test_neighbours_are_all_and_once(shard):
    unused = np.ones(shard.n, bool)
    unused[[0, 5]] = False
    got = []
    for d in shard.neighbours(0, unused):
        unused[d] = False
        got.append(d)
    assert sorted(got) == [k for k in range(shard.n) if k not in (0, 5)]
    exact = shard.scores(0)
    assert np.allclose(shard.rescored(0, np.arange(shard.n)), exact, rtol=1e-4)
    assert sorted(P.order_of(shard)) == list(range(shard.n))


def test_group_of_texts_is_encoded_as_each_is():
    tok = P.Tokenizer()
    odd = ["", " ", "a b", " a", "a ", "a  b", "\n a", "a\n b", "x <|endoftext|> y", "é ü", "a b c", "it's we'll ", "1234567 89", " " * 300_000, "y" * 5000 + " z", "퟿ \U0001f600 x"]
    want = [np.array(tok.whole.encode(t, add_special_tokens=False).ids, np.uint16).tobytes() for t in odd]
    assert tok.encode_all(odd) == want == [tok.encode(t) for t in odd] == tok.encode_all(odd, 1)
    assert tok.encode_all([]) == []


def test_parts_have_like_tokens(spark):
    """A third of the rows are copies of one text; lengths differ a lot."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 400))))) for k in range(1200)] + [(5000 + k, "the same text of a hot group " * 20) for k in range(600)]
    small, P.PART_TOKENS = P.PART_TOKENS, 40_000
    try:
        got = P.pack_documents(spark, docs(spark, rows)).collect()
    finally:
        P.PART_TOKENS = small
    held = {}
    for r in got:
        held[r.sequence_id >> 40] = held.get(r.sequence_id >> 40, 0) + r.length
    assert len(held) > 8 and max(held.values()) < 2 * np.median(list(held.values()))
    assert {r.doc_id for r in got} == {i for i, _ in rows}


def test_many_tiny_texts(spark):
    import time

    ids = [np.array([k % 7 + 2, 1], np.uint16) for k in range(P.SHARD_DOCUMENTS)]
    at = time.perf_counter()
    assert len(list(P.order_of(P.Shard(ids, np.ones(P.VOCABULARY, np.float32), 2.0)))) == len(ids)
    assert time.perf_counter() - at < 20
