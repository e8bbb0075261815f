"""License scan with DataFrame functions alone: MinHash bands retrieve, exact containment verifies.

Texts are normalised (letters a-z and digits in lower case, all else one space) and cut into
overlapping windows of `WIDTH` words, a new one every `STEP` words; templates are windowed at
every word. A window's signature is the minimum of each of `BANDS` hashes over its five-word
shingles, and each minimum is a band of one row: windows of Jaccard similarity s share a band
with probability 1 - (1 - s) ** BANDS. A template of WIDTH - STEP words or fewer lies whole in
some window of WIDTH - 4 shingles, so even one shingle in eight collides with probability 0.9998;
a longer verbatim template fills whole windows and collides surely. Retrieved templates are then
verified by exact containment: at least `CONTAINED` of the template's shingles occur around the
window.

A text that lacks every anchor of every template cannot contain four fifths of any one (each
template has an anchor in more than a fifth of its shingles), and skips the windowing.

Templates of fewer than five words are one shingle each, of their own width, which a text has or
lacks: they are looked up at every word of the texts that hold their longest word, and compared
word by word.

Defined results: null, empty and very short texts match nothing; texts are scanned whole; a
template found at several places is reported once, at the first of its best matches; repeated rows
each count; a null doc_id is carried along; an empty table gives an empty result; a template
without a word matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import id_text, shuffle_width, staged

WIDTH, STEP, SHINGLE, BANDS = 12, 4, 5, 64
CONTAINED = 0.8

# Notices by which texts are licensed.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-notice": "This work is licensed under the GNU Lesser General Public License.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright by the author. All rights reserved.",
}

# Notices of fewer words than a shingle has.
SHORT_NOTICES = {
    "all-rights-reserved-notice": "All rights reserved.",
    "some-rights-reserved-notice": "Some rights reserved.",
    "no-rights-reserved-notice": "No rights reserved.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
}


def normalised(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which a text must have one to reach CONTAINED of any template."""
    out: set[str] = set()
    for text in templates.values():
        w = template_words(text)
        k = min(SHINGLE, len(w))
        every = [w[i : i + k] for i in range(len(w) - k + 1)]
        needed = int(len(every) * (1 - CONTAINED) + 1e-9) + 1  # so many shingles cannot all be missing
        for word in sorted(set(w), key=lambda x: (x not in out, -len(x), x)):
            if sum(bool(out & set(g)) for g in every) >= needed:
                break
            out.add(word)
    return sorted(out)


def shingle_hashes(words: F.Column) -> F.Column:
    last = F.size(words) - SHINGLE
    spans = F.sequence(F.lit(0), last)
    return F.when(last >= 0, F.transform(spans, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def signature(hashes: F.Column) -> F.Column:
    """The least value of each band's hash, which tells the band as well."""

    def least(band: int) -> F.Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*(least(j) for j in range(BANDS)))


def windows(rows: DataFrame, step: int) -> DataFrame:
    """rows with `sh` cut into (at, part): slices of WIDTH words' shingles every `step` words."""
    span = WIDTH - SHINGLE + 1
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("sh") - span + step - 1), F.lit(step))
    return rows.where(F.size("sh") > 0).withColumn("at", F.explode(starts)).withColumn("part", F.slice("sh", F.col("at") + 1, span)).where(F.size("part") > 0)


def short_matches(spark: SparkSession, docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The first place of every template of fewer than SHINGLE words in docs' words `w`."""
    bodies = {k: template_words(t) for k, t in sorted(templates.items())}
    known = F.broadcast(spark.createDataFrame([(k, " ".join(w)) for k, w in bodies.items()], "template_id string, body string"))
    found = None
    for width in sorted({len(w) for w in bodies.values()}):
        keys = [F.xxhash64(*(F.lit(x) for x in w)) for w in bodies.values() if len(w) == width]
        last = F.size("w") - width
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        like = F.filter(every, lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(width))).isin(*keys))
        hits = F.transform(like, lambda i: F.struct(i.cast("long").alias("at"), F.concat_ws(" ", F.slice("w", i + 1, F.lit(width))).alias("body")))
        part = docs.select("doc_id", "row", F.explode(hits).alias("h")).select("doc_id", "row", "h.*")
        found = part if found is None else found.unionByName(part)
    first = found.join(known, "body").groupBy("row", "doc_id", "template_id").agg(F.min("at").alias("word_start"))
    return first.select("doc_id", "template_id", F.lit(1.0).alias("containment"), "word_start")


def scan_licenses(spark: SparkSession, documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template_id, containment and word_start of every template in every document."""
    given = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if template_words(t) != [""]}
    if not given:
        return spark.createDataFrame([], "doc_id long, template_id string, containment double, word_start long")
    templates = {k: t for k, t in given.items() if len(template_words(t)) >= SHINGLE}
    short = {k: t for k, t in given.items() if k not in templates}
    low = F.lower("text")

    def has(some: dict[str, str]) -> F.Column:
        out = F.lit(False)
        for a in anchors(some):
            out = out | F.contains(low, F.lit(a))
        return out

    docs = id_text(documents).select(F.col("doc_id").cast("long"), "text", has(templates).alias("long"), has(short).alias("short")).where("long OR short")
    # Written between the steps: the optimiser would repeat the split for every word otherwise.
    docs = staged(spark, docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(normalised(F.col("text")), " ").alias("w"), "long", "short"), "license-words")
    if not templates:
        return short_matches(spark, docs.where("short"), short)
    found = long_matches(spark, docs.where("long"), templates)
    return found.unionByName(short_matches(spark, docs.where("short"), short)) if short else found


def long_matches(spark: SparkSession, docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The best place of every template of SHINGLE words or more in docs' words `w`."""
    known = spark.createDataFrame(sorted(templates.items()), "template_id string, body string")
    known = known.select("template_id", F.split(normalised(F.col("body")), " ").alias("w"))
    known = known.select("template_id", F.size("w").alias("words"), shingle_hashes(F.col("w")).alias("sh")).withColumn("wanted", F.array_distinct("sh"))
    bands = windows(known, 1).select("template_id", F.explode(signature(F.col("part"))).alias("key")).distinct()
    bands = bands.groupBy("key").agg(F.collect_set("template_id").alias("ids"))  # bounded by the templates given

    docs = staged(spark, docs.select("doc_id", "row", shingle_hashes(F.col("w")).alias("sh")), "license-shingles")
    docs = docs.repartition(4 * shuffle_width(spark), "row")  # few bytes, much work
    longest = max(len(template_words(t)) for t in templates.values())
    # A window's bands travel without its shingles, which only the retrieved ones need.
    keys = windows(docs, STEP).select("row", "at", F.explode(signature(F.col("part"))).alias("key"))
    met = keys.join(F.broadcast(bands), "key").select("row", F.explode("ids").alias("template_id"), "at").distinct()
    met = met.groupBy("row").agg(F.collect_list(F.struct("template_id", "at")).alias("hits"))  # bounded by the text's own windows

    def place(h: F.Column) -> F.Column:
        start = F.greatest(F.lit(0), h["at"] - longest)
        return F.struct(h["template_id"].alias("template_id"), start.alias("from"), F.slice("sh", start + 1, 2 * longest + WIDTH).alias("around"))

    met = docs.join(met, "row").select("doc_id", "row", F.explode(F.transform("hits", place)).alias("h")).select("doc_id", "row", "h.*")
    wanted = F.broadcast(known.select("template_id", "wanted"))
    hit = F.size(F.array_intersect("around", "wanted")) / F.size("wanted")
    first = F.array_min(F.filter(F.transform("wanted", lambda x: F.array_position("around", x)), lambda p: p > 0))
    met = met.join(wanted, "template_id").select("doc_id", "row", "template_id", hit.alias("containment"), (F.col("from") + first - 1).cast("long").alias("word_start"))
    best = met.where(F.col("containment") >= CONTAINED).groupBy("row", "doc_id", "template_id").agg(F.max(F.struct("containment", (-F.col("word_start")).alias("s"))).alias("m"))
    return best.select("doc_id", "template_id", F.col("m.containment").alias("containment"), (-F.col("m.s")).alias("word_start"))
