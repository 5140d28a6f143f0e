"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles have five words.  A text is cut into
windows of six words, two apart, so each window overlaps the next by four words and holds two shingles,
and every shingle of the text lies in a window.  A window has BANDS bands of one MinHash row each; a
template is cut into windows at every word, and at its two ends into windows of one shingle.  A passage
that holds a template whole has a window that shares half of its shingles with a template window or all
of them, so a band misses it with probability 1/2 at most and all ten with less than 0.001, also for a
template of a single shingle; longer templates have more windows, most of them equal to one of the text,
which all bands find.  A template of at most ``SHORT`` shingles has one more key for each of its shingles, which meets
both shingles of every window as they are, so it isn't missed at all.

Windows with a band key of any template are few; they meet the templates in a join by band key, and the
text around the window (as many shingles as the longest template has, on both sides) is checked for the
exact share of the template's shingles, which must reach ``CONTAINMENT``.  Templates that share much of their
text (``SIBLINGS``; versions of one notice) can both reach it at the same place; of those that do, the place
counts for the ones with the largest share alone, so a notice of one version isn't one of another.

Defined results: null and empty texts and texts of fewer than five words match nothing; one row for each
doc_id and template, with the largest containment and the first word of its first window; rows that
repeat a doc_id count as one document (null doc_ids as one, too); equal containments keep the smaller
position.  An empty table gives an empty result.  Other columns are not read, so names can't clash.

Scale: DataFrame functions only; one pass over whole texts without a shuffle of texts.  The templates are
fixed and few, so that Spark broadcasts their table by its size; matches are pre-aggregated by document and template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = 5
BANDS = 10
SHORT = 2
CONTAINMENT = 0.8
#: Templates are siblings if they share so much of the shorter one's shingles.
SIBLINGS = 0.5

# Short standard notices by license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """Add ``sh``, the hashes of the text's five-word shingles in order."""
    words = df.withColumn("words", F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"))
    parts = ", ".join(f"words[i + {k}]" for k in range(WORDS))
    return words.withColumn("sh", F.expr(
        f"CASE WHEN size(words) < {WORDS} THEN array() ELSE "
        f"transform(sequence(0, size(words) - {WORDS}), i -> xxhash64({parts})) END")).drop("words")


def _band(first: str, second: str, band: int) -> str:
    """SQL of a window's key: the smaller of its shingles' hashes under the band's permutation."""
    return f"least(xxhash64({first}, {band}L), xxhash64({second}, {band}L))"


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, sh: distinct shingles, keys: its windows' (band, key)) of all templates."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
                     for i, (name, text) in enumerate(TEMPLATES)])
    # A template that ends in a sign ends in an empty word, which is no part of it.
    base = spark.range(1).select(F.inline(rows)).withColumn("text", F.regexp_replace("text", "[^\\p{L}\\p{N}]+$", ""))
    base = _shingled(base, "text")
    # Pairs of neighbours, and each end alone.
    windows = base.withColumn("w", F.expr("concat(transform(sequence(1, size(sh)), i -> struct(sh[i - 1] AS a, "
                                          "coalesce(get(sh, i), sh[i - 1]) AS b)), array(struct(sh[0] AS a, sh[0] AS b)))"))
    keys = ", ".join(f"struct({b} AS band, {_band('w.a', 'w.b', b)} AS key)" for b in range(BANDS))
    return windows.select("template", "license", F.array_distinct("sh").alias("sh"),
                          F.array_distinct(F.concat(
                              F.flatten(F.expr(f"transform(w, w -> array({keys}))")),
                              F.expr(f"transform(filter(sh, x -> size(sh) <= {SHORT}), x -> struct({BANDS} AS band, x AS key))"))).alias("keys"))


def families(sets: list[set[int]]) -> list[int]:
    """The family of each template: the first of those that siblings connect it with."""
    family = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= SIBLINGS * min(len(a), len(b)):
                old, new = max(family[i], family[j]), min(family[i], family[j])
                family = [new if f == old else f for f in family]
    return family


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, license, containment and word (place of the first matching window's first word)."""
    spark = docs.sparkSession
    known = templates(spark).collect()  # fixed: one row for each of TEMPLATES
    longest = max(len(t["sh"]) for t in known)
    by_band: list[set[int]] = [set() for _ in range(BANDS + 1)]
    for t in known:
        for k in t["keys"]:
            by_band[k["band"]].add(k["key"])
    second = "coalesce(get(sh, j + 1), sh[j])"
    key_of = [[_band("sh[j]", second, b)] for b in range(BANDS)] + [["sh[j]", second]]
    hit = " OR ".join(f"{of} IN ({', '.join(f'{k}L' if k != -2**63 else str(k) for k in sorted(keys))})"
                      for keys, of_band in zip(by_band, key_of) if keys for of in of_band)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    shingled = _shingled(text, "text").select("doc_id", "sh")
    # The outer form keeps the optimizer from putting a filter with the whole expression below.
    places = f"CASE WHEN size(sh) > 0 THEN filter(sequence(0, size(sh) - 1, 2), j -> {hit}) END"
    placed = shingled.withColumn("j", F.explode_outer(F.expr(places))).where("j IS NOT NULL")
    around = F.expr(f"slice(sh, greatest(j - {longest}, 0) + 1, {2 * longest + 2})")
    keys = ", ".join(f"struct({b} AS band, {of} AS key)" for b, of_band in enumerate(key_of) for of in of_band)
    windows = placed.select("doc_id", "j", around.alias("around"), F.expr(f"array({keys})").alias("keys"))
    each = windows.select("doc_id", "j", "around", F.inline("keys"))
    bands = templates(spark).select("template", "license", F.col("sh").alias("t_sh"), F.inline("keys"))
    met = each.join(bands, ["band", "key"])
    share = F.size(F.array_intersect("around", "t_sh")) / F.size("t_sh")
    family = F.array(*[F.lit(f) for f in families([set(t["sh"]) for t in sorted(known, key=lambda t: t["template"])])])
    # One row for each place (a text's hash tells repeated doc_ids apart) and template, added up before the shuffle.
    found = (met.withColumn("containment", share).where(F.col("containment") >= containment)
             .groupBy("doc_id", "j", F.xxhash64("around").alias("place"), "template", "license")
             .agg(F.max("containment").alias("containment")).withColumn("family", family[F.col("template")]))
    at_place = Window.partitionBy("doc_id", "j", "place", "family")  # at most the templates of a family
    return (found.withColumn("most", F.max("containment").over(at_place)).where("containment = most")
            .groupBy("doc_id", "template", "license", "containment").agg(F.min("j").alias("word"))
            .groupBy("doc_id", "template", "license").agg(
                F.max(F.struct("containment", (-F.col("word")).alias("word"))).alias("m"))
            .select("doc_id", "template", "license", "m.containment", (-F.col("m.word")).alias("word")))
