"""The Jaccard join: common tokens in chunks, ids with several texts, hot groups, and its filters."""

import random

import numpy as np
import pytest

from tabulith.llm import common, jaccard_join as J
from tests.llm.test_operators import brute_components, corpus, docs, sets


def shared(seed=3):
    """Texts that share a passage which makes up much of them, in several sizes, and near copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    for k in range(90):
        t = passage[: r.randint(30, 60)] + [r.choice(words) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append((k + 1, " ".join(t)))
    return out


@pytest.mark.parametrize("kw", [{"big": 2, "chunk": 3}, {"part_postings": 300, "hot": 2, "big": 5, "chunk": 2}])
def test_common_tokens_in_chunks(spark, kw):
    rows = shared() + [(500 + i, t) for i, t in corpus(7, 60)]
    got = J.jaccard_components(spark, docs(spark, rows), **kw).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_filters_lose_no_link():
    rows = shared(5) + [(500 + i, t) for i, t in corpus(9, 80)]
    hashes, every = common.WordHashes(), sets(rows)
    got = {i: common.shingles(common.words_of(t), hashes) for i, t in rows}
    signs = {i: J.signature(s) for i, s in got.items()}
    ids, linked, passed = sorted(got), 0, 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(every[a] & every[b])
            link = 100 * both >= 80 * (len(every[a]) + len(every[b]) - both)
            meet = J.orders_meet(signs[a], signs[b])
            linked, passed = linked + link, passed + meet
            assert meet or not link
    assert 0 < linked <= passed < len(ids) * (len(ids) - 1) / 4
    big, small = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)), None
    small = big[:2450]
    assert J.signature(big)[0] == 4 and J.orders_meet(J.signature(big), J.signature(small))
    assert J.orders(J.signature(big[:600]), 2) == J.orders(J.signature(big[:600])) and not J.orders_meet(J.signature(big[:400]), J.signature(big[2000:2400]))


def test_one_id_with_two_texts(spark):
    """Rows of one id with other texts are documents of their own; what each is linked to stays apart."""
    a, b = "a b c d e f g h i j k l", "p q r s t u v w x y z"
    rows = [(9, a), (9, b), (3, a + " "), (4, b + "\n"), (20, "one two"), (20, "three four"), (21, "one two"), (22, "three four")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(spark, docs(spark, rows)).collect())
    assert got == [(3, 8, 3), (4, 7, 4), (9, 7, 4), (9, 8, 3), (20, 1, 20), (20, 1, 20), (21, 1, 20), (22, 1, 20)]


def test_hot_group(spark):
    """A third of the rows are near copies of one text, in one component."""
    r = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(300):
        t = list(base)
        t[r.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(t)))
    rows += [(1000 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(30))) for k in range(500)]
    got = {x.doc_id: x.component_id for x in J.jaccard_components(spark, docs(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()} and sum(c == 0 for c in got.values()) == 300


def test_keep_one(spark):
    rows = [*corpus(11, 60), (3, "one two"), (1, "one  two"), (1, "one two"), (None, "one two"), (50, ""), (51, None), (50, "")]
    left = J.keep_one(spark, docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    keyed = [(k, t) for k, (i, t) in enumerate(rows)]
    want = {}
    comp = brute_components([(k, t) for k, t in keyed if rows[k][0] is not None])
    for k, (n, c) in comp.items():
        key = ("alone", k) if not n else ("group", c)
        want[key] = min(want.get(key, (10**9, 0)), (rows[k][0], k))
    kept = [rows[k] for _, k in want.values()] + [r for r in rows if r[0] is None]
    assert [(a, b) for a, b, _ in got] == sorted((i is None, i or 0) for i, _ in kept)
    assert J.keep_one(spark, docs(spark, rows).limit(0)).count() == 0


def test_star(spark):
    """Labels over a star, a chain and a pair."""
    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 4999)]
    got = dict(common.components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(400)}, **{k: 1000 for k in range(1000, 1071)}, 5000: 4999, 4999: 4999}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
