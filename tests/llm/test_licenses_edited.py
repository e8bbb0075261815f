"""Notices that were edited, against exact containment by brute force, and odd texts."""

import random
import re

from tabulith.llm import licenses
from tests.llm.test_operators import ODD, docs


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_edited_notices(spark):
    r = random.Random(6)
    fill = [f"filler{k}" for k in range(300)]
    rows, want, total = [], set(), 0
    for k in range(400):
        name = r.choice(sorted(licenses.TEMPLATES))
        t = re.sub("[^a-z0-9]+", " ", licenses.TEMPLATES[name].lower()).strip().split(" ")
        for _ in range(r.choice((0, 1, 1, 2))):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice(([], [r.choice(fill)], [t[at], r.choice(fill)]))
        text = [r.choice(fill) for _ in range(r.randint(0, 60))] + t + [r.choice(fill) for _ in range(r.randint(0, 60))]
        rows.append((k, " ".join(text)))
        for n, body in licenses.TEMPLATES.items():
            g = grams(re.sub("[^a-z0-9]+", " ", body.lower()).strip().split(" "))
            if len(g & grams(text)) >= 0.8 * len(g):
                want.add((k, n))
                total += 1
    got = {(x.doc_id, x.template_id) for x in licenses.scan_licenses(spark, docs(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and total > 150


def test_odd(spark):
    long = "filler words " * 40_000 + "Released under the MIT License. " + "filler words " * 100
    rows = [*ODD, (60, long), (60, long), (61, "All rights reserved."), (62, "all RIGHTS, reserved")]
    got = sorted((r.doc_id, r.template_id, r.word_start) for r in licenses.scan_licenses(spark, docs(spark, rows), licenses.TEMPLATES | licenses.SHORT_NOTICES).collect())
    assert got == [(60, "mit-notice", 80_000)] * 2 + [(61, "all-rights-reserved-notice", 0), (62, "all-rights-reserved-notice", 0)]
    assert licenses.scan_licenses(spark, docs(spark, rows).limit(0)).count() == 0
