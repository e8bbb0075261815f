"""Benchmarks with repeated, hot or common-worded items: the bounds lose no item that full scoring finds."""

import random

import numpy as np
import pytest

from tabulith.llm import decontaminate as d


def items(seed=3, n=20, words=26):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(3000)}" for _ in range(words)) + "? " + " ".join(f"w{r.randrange(3000)}" for _ in range(words)) for _ in range(n)]


def brute(index, text):
    """Every passage against every part, without bounds."""
    raw, out = d.words(text), {}
    for p in range(-(-(len(raw) - d.PASSAGE) // d.STRIDE) + 1 if len(raw) > d.PASSAGE else 1):
        have = set(raw[p * d.STRIDE : p * d.STRIDE + d.PASSAGE])
        score = np.zeros(len(index.parts))
        for w in have & set(index.ids):
            part, v = index.of(index.ids[w])
            score[part] += v
        for k, (item, _) in enumerate(index.parts):
            q, a = index.halves[item]
            around = raw[max(0, p * d.STRIDE - len(q) - len(a)) : p * d.STRIDE + d.PASSAGE + len(q) + len(a)]
            if score[k] >= d.THRESHOLD and min(d.overlap(q, around), d.overlap(a, around)) >= d.OVERLAP:
                out[index.items[item][0]] = max(out.get(index.items[item][0], 0), round(float(score[k]), 6))
    return out


@pytest.mark.parametrize("bench", [items() * 2, items(n=60) + items(n=1) * 40, items(n=200) + ["the of and to in? is that it was for"] * 60, items()])
def test_nothing_is_lost(bench):
    index = d.Index(list(enumerate(bench)))
    m, r = d.Matcher(index), random.Random(1)
    filler = " ".join(f"x{r.randrange(500)}" for _ in range(300))
    for text in sorted({bench[0], bench[-1]}):
        for doc in (text, f"{filler} {text} {filler}", text.upper()):
            got = {i: s for i, s, *_ in m.match(doc)}
            assert set(got) >= {i for i, t in enumerate(bench) if t == text}
            want = brute(index, doc)
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-6 for i in got)
    assert m.match(filler) == [] and m.match("") == [] and m.match(None) == []
    assert (index.need > 0).all()
