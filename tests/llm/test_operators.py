"""Each training-data operator against brute force on small tables, with their odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tabulith.llm import chat, decontaminate, exact_dedup, extraction, jaccard_join, licenses, packing, quality, secrets, toxicity
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "  \t"), (4, "one two"), (5, "one  two"), (None, "one two"), (6, "one two"), (6, "one two"), (7, "word " * 30000), (8, "ünï cödé <|endoftext|> x")]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:  # names that operators use inside
        for c in ("digest", "row", "score", "kept", "n", "fp", "label", "key", "digest_"):
            df = df.selectExpr("*", f"1 AS {c}")
    return df


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            t = list(r.choice(out))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.randint(1, 90))]
        out.append(t)
    return [(i * 3, " ".join(t)) for i, t in enumerate(out)]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(spark):
    df = docs(spark, ODD)
    got = exact_dedup.exact_dedup(spark, df).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(hashlib.sha256(normal(t).encode()).hexdigest(), []).append(i)
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(x for x in g if x is not None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_copies(spark, df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(spark, df.limit(0)).count() == 0


def test_digest_index_remembers(spark, tmp_path):
    path = f"{tmp_path}/digest_index_t"
    one = exact_dedup.exact_dedup(spark, docs(spark, [(5, "a"), (9, "b")]), path).collect()
    two = {r.doc_id: r for r in exact_dedup.exact_dedup(spark, docs(spark, [(1, "a"), (2, "c")]), path).collect()}
    assert all(r.kept for r in one)
    assert (two[1].keep_id, two[1].kept, two[2].kept) == (5, False, True)


def sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(rows):
    s = sets(rows)
    up = {i: i for i in s}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in ids}


@pytest.mark.parametrize("kw", [{}, {"part_postings": 200, "hot": 3}])
def test_jaccard(spark, kw):
    rows = corpus()
    got = jaccard_join.jaccard_components(spark, docs(spark, rows), **kw).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_odd(spark):
    rows = [*ODD, (20, "one two")]
    got = jaccard_join.jaccard_components(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (4, 5, 6, 20)} == {(1, 4)}
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    assert all(r.component_id == r.doc_id and not r.n_shingles for r in got if r.doc_id in (1, 2, 3))
    assert jaccard_join.jaccard_components(spark, docs(spark, rows).limit(0)).count() == 0
    left = jaccard_join.keep_one(spark, docs(spark, corpus()))
    assert {r.doc_id for r in left.collect()} == {c for _, c in brute_components(corpus()).values()}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in ODD if r[0] != 6] + corpus()
    got = packing.pack_documents(spark, docs(spark, rows)).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(ids)
    for i, pieces in by.items():
        if len(ids[i]) > 1:
            continue
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i][0])
            assert p.ids_crc32 == zlib.crc32(ids[i][0][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i][0])
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in ends.values())
    assert packing.pack_documents(spark, docs(spark, rows).limit(0)).count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH23456789"
    rows = [*ODD, (30, f"ü Password: 'abc12345' x {key} " + "0f" * 20), (31, "token=abc secret = longenough1"), (32, "user: admin host=db.example.org\nkey Zx81kQpLm2Nv7RtYw3Bc9Df4\n"), (33, "user: admin is here, nothing else"), (34, "paſsword=abcdefgh1")]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, rows)).collect()}
    assert (got[30].n_assign, got[30].n_access, got[30].n_hex) == (1, 1, 1)
    assert got[30].spans.startswith("assign:2:21") and got[30].base_sha256 == hashlib.sha256(got[30].spans.encode()).hexdigest()
    assert got[31].n_assign == 1 and "weak_secret" in got[32].spans and got[33].spans == "" and got[34].n_assign == 0
    assert secrets.find_secrets(docs(spark, rows)).count() == len(rows)


def test_extraction(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">home</a></nav><div class="sidebar">more</div><article><h1>Title &amp; all</h1><p>It is a text of the\n kind that has <b>bold</b>ness.<br><p>Short.</p><div class="comments"><p>I am the first to say it is good.</p></div></article><form>q</form><footer>&copy; x</footer><script>var a="<p>";</script></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "<p></p>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract_pages(df).collect()}
    assert got == {1: "Title & all It is a text of the kind that has boldness. Short.", 2: "", 3: "", 4: ""}


def test_toxicity(spark):
    df, lab = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.score_documents(spark, df, lab).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    odd = docs(spark, ODD)
    assert toxicity.score_documents(spark, odd, lab).count() == len(ODD)
    assert toxicity.score_documents(spark, odd, lab.limit(0)).count() == len(ODD)


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "what is the tallest peak of the northern range? it is the old grey mountain by the lake"), (2, None), (3, "")], "item_id long, text string")
    rows = [*ODD, (40, "filler words here " * 50 + "What is the tallest peak of the northern range? It is the old grey mountain by the lake " + "other words " * 90), (41, "what is the tallest peak of the northern range? nobody knows that today or ever")]
    df = docs(spark, rows)
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, df, bench).collect()] == [(40, 1)]
    left = decontaminate.drop_leaks(spark, df, bench)
    assert left.columns == df.columns and left.count() == len(rows) - 1
    assert decontaminate.drop_leaks(spark, df, bench.limit(0)).count() == len(rows)
    small, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in small.collect() for b in items.collect() if b.text in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, small, items).collect()}


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, None, "x"), (2, None, "ann", "y"), (None, 1, "ann", "z"), (None, 1, "ann", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS k", "2 AS size")
    got = chat.rotate(spark, df).collect()
    assert len(got) == 4 * 3 + 1 + 2
    for who in ("ann", "bob", "unknown"):
        segs = sorted((r for r in got if r.conv_id == 1 and r.perspective == who), key=lambda r: r.char_start)
        text = "".join(r.segment for r in segs)
        assert [r.char_start for r in segs] == [0, *(r.char_end for r in segs[:-1])]
        for r in segs:
            assert (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_end] == {"ann": "hi", "bob": "", "unknown": "x"}[who]
    assert chat.rotate(spark, df.limit(0)).count() == 0


def test_licenses(spark):
    rows = [*ODD, (50, "a b c d\nReleased under the MIT License. e f"), (51, "Licensed under the Apache License,\n Version 2.0."), (52, "the license is under dispute")]
    got = {(r.doc_id, r.template_id) for r in licenses.scan_licenses(spark, docs(spark, rows)).collect()}
    assert got == {(50, "mit-notice"), (51, "apache-2.0-notice")}
    plan = licenses.scan_licenses(spark, docs(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_brute(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {(r.doc_id, r.template_id) for r in licenses.scan_licenses(spark, df).collect()}

    def grams(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).strip().split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for d in df.collect():
        have = grams(d.text)
        for k, t in licenses.TEMPLATES.items():
            if len(grams(t) & have) >= 0.8 * len(grams(t)):
                want.add((d.doc_id, k))
    assert got == want


def test_quality(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = quality.classify(spark, df).collect()
    assert len(got) == df.count()
    good = [r.score for r in got if lab.get(r.doc_id) == 1]
    bad = [r.score for r in got if lab.get(r.doc_id) == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert quality.classify(spark, docs(spark, ODD)).count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline as c

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = df
    for _, stage in c.STAGES[:-1]:
        left = c.common.staged(spark, stage(spark, left, SMALL), "test")
        assert left.columns == df.columns
    ids = {r.doc_id for r in left.collect()}
    assert {r.doc_id for r in c.run(spark, SMALL).collect()} == ids


def test_parity_bound_loses_no_link():
    """The bits never tell more differences than there are, across widths; equal sets differ in none."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 2, 31, 32, 33, 40, 300, 900, 1100, 2500)]
    sets += [np.unique(np.r_[s[len(s) // 10 :], rng.integers(0, 2**63, 3).astype(np.uint64)]) for s in sets]
    bound = jaccard_join.ParityBound([jaccard_join.parity(s) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    told = bound.apart(i, j, step=7)
    assert (told <= true).all() and (told[i == j] == 0).all()
    near = (i != j) & (true < 40) & (true > 0)
    assert near.any() and (told[near] > 0).any()
