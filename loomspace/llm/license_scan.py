"""License scans: MinHash bands retrieve templates for windows of text, containment verifies them.

Texts and templates become words (runs of letters and digits, lower-cased) and shingles of
five words; a template of fewer words is one shingle, its whole word sequence, and texts are
cut into shingles of that length for it.  For a template of s shingles, windows of L = s + ceil(s/4) shingles begin at
every ceil(s/4)-th shingle of a text.  A window that holds a share of at least 0.8 of the
template's shingles has a Jaccard similarity of at least 0.8 / 1.45 = 0.55 with it, up to
the rounding of L.  Each of 20 bands is one minimum, so that such a window collides with
probability 1 - 0.45^20, more than 1 - 2e-7.  The windows that collide are verified by the
exact share of the template's shingles that they hold.

A band collides only where the window's minimum is the template's, so a window without any
of the templates' minima can't collide.  Those minima (bands x templates numbers, bounded
by `bound`) are looked for in each text first, and only texts and windows that have one are
hashed band by band: the windows retrieved are the same.  Everything is DataFrame
functions; there is no shuffle.

`bound` limits the templates and their minima, as these go to all tasks; more raise.

Defined results: null texts and texts shorter than a template's shingle don't match it.  A
template without words matches nothing; equal templates match alike.  A text has one row for each
template found in it: the best share and the first window that has it.  Repeated rows give
repeated matches; empty tables give none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text
from .license_texts import BODIES, whole, wordings

SHINGLE = 5
SHARE = 0.8
BANDS = 20
BOUND = 50_000

# Notices by which public licenses are usually stated.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def notices(spark: SparkSession) -> DataFrame:
    """template_id, text: the notices, the usual wordings of each license, passages of the licenses' own texts, and the whole texts."""
    flat = lambda t: re.sub(r"\W+", " ", t.lower()).strip()
    known = {flat(t) for t in NOTICES.values()}
    every = NOTICES | BODIES | whole() | {k: t for k, t in wordings().items() if flat(t) not in known}
    return spark.createDataFrame(list(every.items()), "template_id string, text string")


def _words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _hashes(words: Column, k: int = SHINGLE) -> Column:
    """The hash of each shingle of k words, in order."""
    whole = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(whole, lambda _, i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def _shingles(words: Column, k: Column) -> Column:
    whole = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.array_distinct(F.transform(whole, lambda _, i: F.array_join(F.slice(words, i + 1, k), " ")))


def _minimum(hashes: Column, band: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row: filters above aren't pushed below a generator, with the value written out in them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def prepared(templates: DataFrame, id_col: str = "template_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """A row per template: its shingles and their length, the minimum and the shingle that has it for each band, window and step."""
    t = _once(templates.select(F.col(id_col).cast("string").alias("template_id"), whole_text(text_col).alias("t")), "w", _words(F.col("t")))
    t = t.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashes = F.coalesce(*(F.when(F.col("k") == k, _hashes(F.col("w"), k)) for k in range(1, SHINGLE + 1)))
    t = t.select("template_id", "k", _shingles(F.col("w"), F.col("k")).alias("shingles"), F.array_distinct(hashes).alias("hs"))
    every = F.sequence(F.lit(0), F.lit(bands - 1))
    t = t.withColumn("minima", F.transform(every, lambda k: _minimum(F.col("hs"), k)))
    first = F.transform(every, lambda k: F.array_min(F.transform(F.col("hs"), lambda h: F.struct(F.xxhash64(h, k).alias("m"), h.alias("h"))))["h"])
    s = F.size("shingles")
    step = F.ceil(s / 4).cast("int")
    return t.withColumn("seeds", F.array_distinct(first)).withColumn("step", step).withColumn("window", (s + step).cast("int")).drop("hs")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, bands: int = BANDS, bound: int = BOUND) -> DataFrame:
    """doc_id, template_id, containment, first_word, n_words: the templates found in each whole text."""
    if templates.limit(bound + 1).count() > bound:
        raise ValueError(f"license scan: more than {bound} templates")
    ready = prepared(templates, bands=bands)
    seeds = ready.select("template_id", "k", F.explode("seeds").alias("seed")).groupBy("seed").agg(F.collect_set("k").alias("ks"), F.sort_array(F.collect_set("template_id")).alias("ids")).limit(bound + 1).collect()
    if len(seeds) > bound:
        raise ValueError(f"license scan: more than {bound} minima of templates")
    if not seeds:
        return docs.sparkSession.createDataFrame([], "doc_id long, template_id string, containment double, first_word int, n_words int")
    known, lengths = [r.seed for r in seeds], sorted({k for r in seeds for k in r.ks})
    named = F.map_from_arrays(F.array(*(F.lit(x) for x in known)), F.array(*(F.array(*(F.lit(i) for i in r.ids)) for r in seeds)))
    d = _once(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")), "w", _words(F.col("t"))).drop("t")
    d = _once(d.where(F.size("w") >= lengths[0]), "each", F.array(*(_hashes(F.col("w"), k) for k in lengths)))
    d = _once(d, "hits", F.array_distinct(F.filter(F.flatten("each"), lambda h: h.isin(known)))).where(F.size("hits") > 0)
    found = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.element_at(named, h))))
    d = d.select("doc_id", "w", "each", F.explode(found).alias("template_id")).join(F.broadcast(ready), "template_id")
    own = F.get("each", (F.array_position(F.array(*(F.lit(k) for k in lengths)), F.col("k")) - 1).cast("int"))
    d = _once(d, "hs", own).drop("each").where(F.size("hs") > 0)
    step, window = F.col("step"), F.col("window")
    d = _once(d, "places", F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.array_contains(F.col("seeds"), F.get(F.col("hs"), i))))
    # The grid's windows that hold such a place.
    grid = lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - window + 1) / step)).cast("int"), F.floor(i / step).cast("int"))
    d = _once(d, "starts", F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("places", grid)), lambda q: q * step))))
    every = F.sequence(F.lit(0), F.lit(bands - 1))
    inside = lambda at: F.slice(F.col("hs"), at + 1, window)
    d = _once(d, "retrieved", F.filter("starts", lambda at: F.exists(every, lambda k: _minimum(inside(at), k) == F.get(F.col("minima"), k))))
    held = lambda at: F.size(F.array_intersect(_shingles(F.slice(F.col("w"), at + 1, window + (F.col("k") - 1)), F.col("k")), F.col("shingles"))) / F.size("shingles")
    d = _once(d, "best", F.array_max(F.transform("retrieved", lambda at: F.struct(held(at).alias("c"), (-at).alias("back")))))
    return d.where(F.col("best.c") >= share).select(
        "doc_id", "template_id", F.col("best.c").alias("containment"), (-F.col("best.back")).cast("int").alias("first_word"),
        F.least(window + (F.col("k") - 1), F.size("w") + F.col("best.back")).cast("int").alias("n_words"),
    )
