"""Decontamination against BM25 scored for every passage and every part, without bounds."""

import math
import random
from collections import Counter

from tabulith.llm import decontaminate as D
from tests.conftest import SMALL
from tests.llm.test_operators import ODD, docs


def brute(items, texts):
    """{(text number, item number)} by the definition: every passage against every part of every item."""
    parts = [(k, p) for k, (_, t) in enumerate(items) for p in D.cut(D.words(t))]
    df, mean = Counter(w for _, p in parts for w in set(p)), sum(len(p) for _, p in parts) / max(1, len(parts))

    def impacts(p):
        idf = lambda w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5))
        got = {w: idf(w) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(p) / mean)) for w, c in Counter(p).items()}
        return {w: v / sum(got.values()) for w, v in got.items()}

    known, out = [(k, impacts(p)) for k, p in parts], {}
    for n, text in enumerate(texts):
        w = D.words(text)
        for start in range(0, max(1, len(w) - D.PASSAGE + D.STRIDE), D.STRIDE):
            have = set(w[start : start + D.PASSAGE])
            for k, imp in known:
                score = sum(v for x, v in imp.items() if x in have)
                if score >= D.THRESHOLD:
                    q, a = D.halves(items[k][1])
                    around = w[max(0, start - len(q) - len(a)) : start + D.PASSAGE + len(q) + len(a)]
                    if D.overlap(q, around) >= D.OVERLAP and D.overlap(a, around) >= D.OVERLAP:
                        out[n, items[k][0]] = max(out.get((n, items[k][0]), 0), round(score, 6))
    return out


def test_every_passage_and_part(spark):
    df, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows, items = df.orderBy("doc_id").collect(), sorted((r.item_id, r.text) for r in bench.collect())
    want = {(rows[n].doc_id, i): s for (n, i), s in brute(items, [r.text for r in rows]).items()}
    got = {(r.doc_id, r.item_id): r.score for r in D.find_leaks(spark, df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and want


def test_damaged_and_common_items():
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(words[: 12 if k < 8 else 60]) for _ in range(r.randint(4, 150)))) for k in range(40)] + [(90, "w1 w2"), (91, "w1 w2"), (92, "")]
    texts = [None, "", "w1", " ".join(r.choice(words) for _ in range(3000))]
    for _ in range(60):
        t = r.choice(items)[1].split()
        for _ in range(r.randint(0, len(t) // 3)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join([r.choice(words) for _ in range(r.randint(0, 300))] + t + [r.choice(words) for _ in range(r.randint(0, 300))]))
    kept = [x for x in items if D.words(x[1])]
    m = D.Matcher(D.Index(items))
    for size in (D.SLICE, 2):
        D.SLICE, before = size, D.SLICE
        got = {(n, h[0]): h[1] for n, t in enumerate(texts) for h in m.match(t)}
        D.SLICE = before
        want = brute(kept, texts)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_a_very_long_text_in_little_memory():
    import tracemalloc

    items = [(k, " ".join(f"w{(k * 37 + j * j) % 900}" for j in range(60))) for k in range(3000)]
    m, r = D.Matcher(D.Index(items)), random.Random(1)
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(400_000)) + " " + items[17][1]
    tracemalloc.start()
    assert 17 in {h[0] for h in m.match(text)}
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_odd(spark):
    bench = spark.createDataFrame([(5, "one two"), (5, "one two"), (6, None), (None, "one two three four five six")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    got = sorted(tuple(r)[:2] for r in D.find_leaks(spark, docs(spark, ODD), bench).collect() if r.doc_id is not None)
    assert {i for i, _ in got} == {4, 5, 6} and len([g for g in got if g[0] == 6]) >= 2
    assert D.find_leaks(spark, docs(spark, ODD).limit(0), bench).count() == 0 and D.find_leaks(spark, docs(spark, ODD), bench.limit(0)).count() == 0
    left = D.drop_leaks(spark, docs(spark, ODD), bench)
    assert left.columns == docs(spark, ODD).columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 7, 8]
    assert D.drop_leaks(spark, docs(spark, ODD).limit(0), bench).count() == 0
