"""The fitted operators against plain versions of their models."""

import math
import random
import re

import numpy as np

from tabulith.llm import common, quality, toxicity
from tests.llm.test_operators import ODD, docs


def test_label_model_against_plain_loops():
    r = random.Random(3)
    patterns = sorted({tuple(r.choice((-1, 0, 0, 1, 1)) for _ in range(4)) for _ in range(40)})
    counts = [r.randint(1, 50) for _ in patterns]
    rates, prior, post = quality.expectation_maximisation(np.array(patterns), np.array(counts, float), rounds=25)
    p = [0.1 if sum(v < 0 for v in x) > 1 else 0.4 if min(x) < 0 else 0.95 for x in patterns]
    for _ in range(25):
        table = {}
        for good in (0, 1):
            for k in range(4):
                add = {-1: 1 if good else 4, 0: 1, 1: 4 if good else 1}
                mass = {v: add[v] + sum(n * (w if good else 1 - w) for x, n, w in zip(patterns, counts, p) if x[k] == v) for v in (-1, 0, 1)}
                for v in mass:
                    table[good, k, v] = mass[v] / sum(mass.values())
        share = (sum(n * w for n, w in zip(counts, p)) + 5) / (sum(counts) + 10)
        p = []
        for x in patterns:
            one, two = share, 1 - share
            for k, v in enumerate(x):
                one, two = one * table[1, k, v], two * table[0, k, v]
            p.append(one / (one + two))
    assert abs(prior - share) < 1e-9 and np.allclose(post, p, atol=1e-9)
    assert all(abs(rates[g, k, v + 1] - table[g, k, v]) < 1e-9 for g, k, v in table)


def test_label_model_finds_the_good_ones():
    """Labellers of known accuracy, one of which only ever says bad."""
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = [np.where(rng.random(len(good)) < a, np.where(good, 1, -1), np.where(good, -1, 1)) * (rng.random(len(good)) < said) for a, said in ((0.9, 0.9), (0.85, 0.7), (0.8, 0.8), (0.75, 1.0))]
    votes.append(np.where(~good & (rng.random(len(good)) < 0.5), -1, 0))
    v = np.stack(votes, 1)
    patterns, back, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    rates, prior, post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - good.mean()) < 0.02 and ((post[back.ravel()] > 0.5) == good).mean() > 0.95
    assert abs(rates[0, 4, 0] - 0.5) < 0.05 and rates[1, 4, 0] < 0.02


def test_quality_scores_against_a_plain_scorer(spark):
    """Same features, spelled out word by word; weights of the fitted scorer."""
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["good", "plain", "words", "the", "a", "of", "##", "%%%", "SHOUT!!", f"w{k % 9}"]) for _ in range(r.randint(0, 80)))) for k in range(150)]
    held = {}
    fit = quality.fit
    quality.fit = lambda *a, **k: held.setdefault("model", fit(*a, **k))
    try:
        got = {x.doc_id: x for x in quality.classify(spark, docs(spark, rows)).collect()}
    finally:
        quality.fit = fit
    w, b = held["model"]
    hashes = common.WordHashes()
    for i, text in rows:
        words = text.split()
        value = {}
        for x in set(words):
            k = hashes[x.encode()] % (quality.BUCKETS - 64) + 64
            value[k] = value.get(k, 0) + words.count(x) / len(words)
        value = {k: math.sqrt(v) for k, v in value.items()}
        if words:
            n, distinct = len(words), set(words)
            for sign, k in ((b"%", 1), (b"#", 2), (b"&", 3), (b"$", 4), (b"*", 5), (b"|", 6), (b"!!", 7)):
                value[k] = 2 * min(1, " ".join(words).count(sign.decode()) / n)
            value |= {9: 2 * (1 - len(distinct) / n), 10: 2 * sum(x.isupper() for x in distinct) / len(distinct), 11: 2 * max(words.count(x) for x in distinct) / n, 12: 2 * min(1, n / 50)}
            value |= {13: 2 * min(1, sum(map(len, words)) / n / 20), 14: 2 * sum(x.encode().isalpha() for x in words) / n, 15: 2}
        else:
            value = {8: 1}
        z = b + sum(float(w[k]) * v for k, v in value.items())
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-4 and got[i].keep == (got[i].score >= 0.5)


def test_quality_odd(spark):
    rows = [*ODD, (6, "other text of six"), (60, "word " * 200_000)]
    got = quality.classify(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.classify(spark, docs(spark, rows).limit(0)).count() == 0


def toxic_corpus(n=400, seed=2):
    r = random.Random(seed)
    fine = ["water", "garden", "morning", "letter", "window", "people", "summer", "little", "music", "bridge"]
    bad = ["scumbag", "worthless", "despicable"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        t = [r.choice(fine) for _ in range(r.randint(8, 30))]
        if toxic:
            t[r.randrange(len(t))] = r.choice(bad)
            t[r.randrange(len(t))] = r.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_scores_against_plain_sums(spark):
    """The logit is the weighted average of what the n-grams of distinct words say, summed one by one."""
    rows, labels = toxic_corpus()
    rows += [(900, "you scumbagg of the garden"), (901, "worthlesss and dispicable you scum-bag"), (902, "water and garden of the morning"), (903, None), (904, "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS text")
    df = docs(spark, rows)
    model = toxicity.train(spark, df, lab)
    got = {r.doc_id: r for r in toxicity.score_documents(spark, df, lab).collect()}
    for i, text in rows:
        top = low = 0.0
        for word in {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}:
            for k in toxicity.word_buckets([word])[0].tolist():
                top += float(model.share[k]) * float(model.weight[k])
                low += float(model.share[k])
        z = model.bias + model.scale * top / (low + toxicity.SMOOTH)
        assert abs(got[i].score - 1 / (1 + math.exp(-max(min(z, 30), -30)))) < 1e-5, i
    assert got[900].predicted == got[901].predicted == 1 and got[902].predicted == 0  # spellings that no text learnt from has
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held) and len(held) > 50


def test_copies_are_learnt_from_once(spark):
    rows, labels = toxic_corpus(200)
    plain = toxicity.train(spark, docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    copies = [(1000 + k, rows[4][1] + ("" if k % 2 else f" {k}")) for k in range(300)]
    more = labels + [(i, 1, 1) for i, _ in copies]
    model = toxicity.training_rows(spark, docs(spark, rows + copies), toxicity.usable_labels(spark.createDataFrame(more, "doc_id long, quality int, toxic int")), toxicity.MAX_PER_CLASS)
    texts = [r.text for r in model.collect()]
    # Of 301 copies nearly all share their smallest shingle.
    assert 1 <= sum(t.startswith(rows[4][1]) for t in texts) <= 30 and len(texts) == len(set(texts))
    assert plain.share.max() > 0


def test_toxicity_odd(spark):
    rows = [*ODD, (60, "word " * 200_000)]
    lab = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(spark, docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.score_documents(spark, docs(spark, rows).limit(0), lab).count() == 0
    assert toxicity.drop_toxic(spark, docs(spark, rows), lab.limit(0)).count() == len(rows)
