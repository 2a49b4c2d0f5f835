"""Scans of whole texts for licence notices, with DataFrame operations only.

Texts and templates are read as lower-case runs of letters and digits, in shingles of five words; a template with fewer words is one
shingle of its own length. Texts are cut into overlapping windows of shingles, and the BANDS least hashes of a window, a bottom-k
MinHash sketch, are its bands of one row each; those of every piece of a template are its bands. A text and a template that share a
band are a candidate, and the exact share of the template's shingles that stands in one stretch of the text decides.

Wherever a notice of more than WINDOW shingles stands, some window shares WINDOW - STEP / 2 shingles with a piece of its template: a
Jaccard similarity of 0.6, and of 0.42 where a fifth of the words differ. Of the BANDS least hashes of both together, none is common
with probability below (1 - 0.42) ** 24 < 3e-6. A template of WINDOW shingles or fewer could drown in a window that it shares with a
longer notice, so it has windows of a single shingle, whose one band is that shingle: none of them is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.common import durable, fresh

SHINGLE = 5
BANDS = 24
WINDOW, STEP = 64, 32
#: More template shingles than this are joined without a broadcast.
BROADCAST_SHINGLES = 200_000

#: Public licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0/short": "licensed under the GNU General Public License, version 3",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT/short": "Released under the MIT License",
    "MIT/licensed": "Licensed under the MIT License",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0",
    "CC-BY-4.0/long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0/short": "dedicated to the public domain under CC0 1.0",
    "Proprietary/reserved": "All rights reserved",
}


def licence_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; none for fewer words."""
    n = F.size(w) - (k - 1)
    run = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<long>"))


def library(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(template, place, h, n): the shingles of each template and how many different ones it has; and all shingle lengths in use."""
    rows = [(name, text) for name, text in sorted(templates.items())]
    t = spark.createDataFrame(rows, "template string, t string").withColumn("w", licence_words(F.col("t"))).where(F.size("w") > 0)
    sizes = sorted({min(SHINGLE, r["n"]) for r in t.select(F.size("w").alias("n")).collect()})
    own = F.coalesce(*[F.when(F.least(F.size("w"), F.lit(SHINGLE)) == k, shingles(F.col("w"), k)) for k in sizes]) if sizes else F.array().cast("array<long>")
    out = t.select("template", F.size(F.array_distinct(own)).alias("n"), F.posexplode(own).alias("place", "h"))
    return durable(out), sizes


def sketches(h: Column, step: int) -> Column:
    """(start, key) of the BANDS least distinct hashes of the windows of WINDOW hashes that begin at every `step`-th."""
    starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def least(at: Column) -> Column:
        keys = F.slice(F.sort_array(F.array_distinct(F.slice(h, at + 1, WINDOW))), 1, BANDS)
        return F.transform(keys, lambda key: F.struct(at.alias("start"), key.alias("key")))

    return F.flatten(F.transform(starts, least))


def apart(places: Column, length: int | Column) -> Column:
    """How many of the ascending places can be taken, each at least `length` after the one before: the first, then the next that fits."""
    start = F.struct(F.lit(-(1 << 40)).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    taken = F.aggregate(places, start, lambda a, p: F.when(p >= a["end"], F.struct((p + length).cast("long").alias("end"), (a["n"] + 1).alias("n"))).otherwise(a))
    return taken["n"]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per document row and template found in it: the kept columns, _row, template, containment, first_word, matches.

    A template is found where at least `least` of its different shingles stand within a stretch one and a quarter times as long;
    containment is the largest such share, first_word the word at which the first such stretch begins (from 0), matches the number of
    such stretches taken from the left, each a template's length after the one before. Whole texts are read. Null and empty texts, and
    an empty list of templates, give no rows; repeated rows are rows of their own; columns of `docs` named like the new ones are replaced.
    """
    spark, made = docs.sparkSession, ["_row", "template", "containment", "first_word", "matches"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    known, sizes = library(spark, TEMPLATES if templates is None else templates)
    pieces = known.where(F.col("n") > WINDOW).groupBy("template").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]).alias("hs"))
    pieces = durable(pieces.select("template", F.explode(sketches(F.col("hs"), 4)).alias("b")).select("template", F.col("b.key").alias("h")).distinct())
    # What a text's shingles (kind 0) and bands (kind 1) are looked up in.
    wanted = known.select(F.lit(0).alias("kind"), "h").distinct().unionByName(pieces.select(F.lit(1).alias("kind"), "h").distinct())
    if known.count() + pieces.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    own, w, hs = fresh("own"), fresh("words"), fresh("shingles")
    # The columns of the documents travel as one, so none of them can clash with those here.
    packed = F.struct(*[F.col(c) for c in kept]) if kept else F.lit(None)
    split = docs.select(packed.alias(own), F.monotonically_increasing_id().alias("_row"), licence_words(F.col(text)).alias(w)).withColumn(hs, shingles(F.col(w), SHINGLE))
    of = lambda k: F.col(hs) if k == SHINGLE else shingles(F.col(w), k)
    runs = [F.transform(of(k), lambda h, i: F.struct(F.lit(0).alias("kind"), i.alias("place"), h.alias("h"))) for k in sizes or [SHINGLE]]
    runs.append(F.transform(sketches(F.col(hs), STEP), lambda b: F.struct(F.lit(1).alias("kind"), b["start"].alias("place"), b["key"].alias("h"))))
    places = split.select(own, "_row", F.explode(F.flatten(F.array(*runs))).alias("r")).select(own, "_row", F.col("r.kind").alias("kind"), F.col("r.place").alias("place"), F.col("r.h").alias("h"))
    found = durable(places.join(wanted, ["kind", "h"]))
    hits, owners = found.where("kind = 0").drop("kind"), known.select("template", "h", "n").distinct()
    candidates = found.where("kind = 1").join(pieces, "h").select("_row", "template").distinct()
    short = hits.join(owners.where(F.col("n") <= WINDOW), "h")
    held = short.unionByName(hits.join(owners.where(F.col("n") > WINDOW), "h").join(candidates, ["_row", "template"]).select(*short.columns))
    # Stretches differ in length by template: one frame per length in use.
    lengths = [r["n"] for r in known.select("n").distinct().collect()]
    per = W.partitionBy("_row", "template").orderBy("place")
    share = None
    for n in lengths:
        got = F.size(F.collect_set("h").over(per.rangeBetween(0, n + n // 4 + SHINGLE)))
        share = F.when(F.col("n") == n, got / n) if share is None else share.when(F.col("n") == n, got / n)
    if share is None:
        share = F.lit(0.0)
    good = held.withColumn("share", share).where(F.col("share") >= least)
    each = good.groupBy("_row", "template", "n").agg(F.first(own).alias(own), F.max("share").alias("containment"), F.min("place").cast("long").alias("first_word"), F.array_sort(F.collect_set("place")).alias("places"))
    return each.select(*[F.col(f"{own}.{c}").alias(c) for c in kept], "_row", "template", "containment", "first_word", apart(F.col("places"), F.col("n")).alias("matches"))
