"""Rotation of conversations that are cut into pieces: hot ones, and turns with one number."""

import random

from tabulith.llm import chat


def test_hot_conversation(spark):
    r = random.Random(2)
    people = ["ann", "bob", "system", None, "unknown"]
    rows = [(1, r.randint(0, 3) if k % 2 else k, r.choice(people), r.choice(["hi", "", None, "x" * r.randint(60, 70) + str(k % 9)])) for k in range(700)] + [(2, 0, "ann", "y")] * 40 + [(None, 5, "cy", "<|end|>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS b", "2 AS th", "3 AS k")
    got = chat.rotate(spark, df).collect()
    convs = {}
    for c, t, s, x in rows:
        convs.setdefault(c, []).append((t, s or "unknown", x or ""))
    for c, turns in convs.items():
        for who in {s for _, s, _ in turns} - {"system"}:
            mine = sorted((g for g in got if g.conv_id == c and g.perspective == who), key=lambda g: g.char_start)
            assert [(g.turn, g.speaker) for g in mine] == sorted((t, s) for t, s, _ in turns)
            assert sorted((g.turn, g.speaker, g.segment.partition("\n")[2][: -len("<|end|>\n")]) for g in mine) == sorted(turns)
            assert mine[0].char_start == 0 and all(a.char_end == b.char_start for a, b in zip(mine, mine[1:]))
            assert all(g.char_end - g.char_start == len(g.segment) for g in mine)
    assert len(got) == sum(len(t) * len({s for _, s, _ in t} - {"system"}) for t in convs.values())
