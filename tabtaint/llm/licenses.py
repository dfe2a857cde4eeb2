"""Licence scans (operator 4): MinHash bands over overlapping text windows, DataFrame functions only.

Texts and templates are lower-cased words (ASCII letters, digits, anything beyond ASCII) and
their 5-word shingles.  For a template of ``m`` shingles, a text is cut into windows of
``W = 2 * 2^ceil(log2 m)`` shingles every ``W / 2``, so a passage as long as the template lies whole
in one window.  A window that contains three quarters of the template has a Jaccard similarity of
at least 0.75 / 4.25 with it; with ``BANDS`` = 96 bands of one MinHash each it is missed with
probability (1 - 0.176) ** 96 < 1e-8.  Retrieved windows are verified on their shingles' words.

A window can only collide with a template in a band if it holds the template's minimum shingle of
that band.  So the corpus is joined with these few shingles first, and a window's own minimum is
computed only where the shingle is present; the retrieved windows are the same.

A template of fewer than five words is one shingle of its own width, found wherever its words stand
in a row.

Defined cases: null and empty texts, and templates without words, match nothing; repeated
rows and rows sharing an id are judged by their own text; empty tables give empty results.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.llm.common import (
    NOT_ALNUM,
    bounded,
    count_alnum_words,
    let,
    lower_ascii,
    row_key,
    split_words,
    stored,
    window_hashes,
)

SHINGLE = 5
SIMILARITY = 0.75
BANDS = 96

#: Customary licence notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                         "file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                      "and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: The notices, and the table of whole licence texts and further notices beside this file.
TEMPLATES = NOTICES | {r["template"]: r["text"] for r in map(
    json.loads, pkgutil.get_data("tabtaint.llm", "licenses.jsonl").decode().removesuffix("\n").split("\n"))}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")


def _words(text: str) -> Column:
    return split_words(lower_ascii(F.col(f"`{text}`")), NOT_ALNUM)


def _hashes(words: Column) -> Column:
    return window_hashes(F.transform(words, lambda w: F.xxhash64(w)), SHINGLE)


def _runs(words: Column, width: int = SHINGLE) -> Column:
    """Each run of ``width`` words as text."""
    return let(words, lambda w: F.slice(
        F.transform(w, lambda x, i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)])),
        F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))))


def _shingles(words: Column) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(_runs(words))


def template_shingles(templates: DataFrame) -> DataFrame:
    """``template, shingles, hashes, window`` of the templates of five words or more."""
    t = templates.select("template", _words("text").alias("words")).where(F.size("words") >= SHINGLE)
    t = t.select("template", _shingles(F.col("words")).alias("shingles"),
                 F.array_distinct(_hashes(F.col("words"))).alias("hashes"))
    return t.withColumn("window", (2 * F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles"))))).cast("int"))


def template_minima(shingles: DataFrame) -> DataFrame:
    """Per template and minimum shingle: its bands and the template's window."""
    bands = shingles.select("template", "hashes", "window", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    least = F.array_min(F.transform("hashes", lambda s: F.struct(F.xxhash64(s, F.col("band")).alias("v"), s.alias("s"))))
    return bands.withColumn("shingle", least["s"]).groupBy("shingle", "template", "window") \
        .agg(F.collect_list("band").alias("bands"))


def _short(d: DataFrame, templates: DataFrame) -> list[DataFrame]:
    """Matches of the templates under five words, one table for each width there is."""
    t = templates.select("template", _words("text").alias("words")).where(F.size("words").between(1, SHINGLE - 1))
    t = stored(t.select("template", F.size("words").alias("width"), F.concat_ws(" ", "words").alias("run")), "short-templates")
    return [d.select("doc_id", "row", F.posexplode(_runs(F.col("words"), r["width"])).alias("word", "run"))
            .join(bounded(t.where(F.col("width") == r["width"]).select("template", "run"), "short-templates"), "run")
            .select("doc_id", "row", "template", "word", F.lit(1.0).alias("containment"))
            for r in t.select("width").distinct().collect()]


def matches(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Verified windows: ``doc_id, row, template, word`` (first word of the window), ``containment``."""
    whole = stored(template_shingles(templates), "template-shingles")
    minima = bounded(template_minima(whole), "template-minima")
    shingles = bounded(whole.select("template", "shingles"), "template-shingles")
    d = docs.select("doc_id", row_key(text).alias("row"), _words(text).alias("words"))
    hit = d.withColumn("hashes", _hashes(F.col("words"))) \
        .select("*", F.posexplode("hashes").alias("pos", "shingle")).join(minima, "shingle")
    half = (F.col("window") / 2).cast("int")
    last = F.floor(F.col("pos") / half).cast("int")
    hit = hit.select("doc_id", "row", "template", "bands", "shingle", "words", "hashes", "window",
                     F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)).alias("g"))
    start = F.col("g") * (F.col("window") / 2).cast("int")
    hit = hit.select("doc_id", "row", "template", "bands", "shingle", start.alias("word"),
                     F.slice("hashes", start + 1, F.col("window")).alias("inside"),
                     F.slice("words", start + 1, F.col("window") + (SHINGLE - 1)).alias("words"))
    collides = F.exists("bands", lambda b: F.array_min(F.transform("inside", lambda s: F.xxhash64(s, b)))
                        == F.xxhash64("shingle", b))
    shared = F.size(F.array_intersect(F.col("shingles"), _shingles(F.col("words"))))
    found = hit.where(collides).drop("inside", "bands", "shingle").join(shingles, "template") \
        .withColumn("containment", shared / F.size("shingles")).where(F.col("containment") >= SIMILARITY) \
        .select("doc_id", "row", "template", "word", "containment").distinct()
    for more in _short(d, templates):
        found = found.unionByName(more)
    return found


def scan(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_licenses, licenses, best_containment``."""
    found = matches(docs, templates, text).groupBy(F.col("doc_id").alias("f_id"), F.col("row").alias("f_row")).agg(
        F.array_sort(F.collect_set("template")).alias("licenses"), F.max("containment").alias("best_containment"))
    d = docs.select("doc_id", row_key(text).alias("row"), count_alnum_words(text).alias("n_words"))
    j = d.join(found, d.doc_id.eqNullSafe(F.col("f_id")) & (d.row == F.col("f_row")), "left")
    licenses = F.coalesce("licenses", F.array().cast("array<string>"))
    return j.select("doc_id", "n_words", F.size(licenses).cast("bigint").alias("n_licenses"),
                    F.array_join(licenses, ",").alias("licenses"),
                    F.coalesce("best_containment", F.lit(0.0)).alias("best_containment"))
