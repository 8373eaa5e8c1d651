"""License scans (operator 6): MinHash bands over overlapping text windows, then exact containment.

DataFrame and SQL functions only. A text is lower-cased and cut into words; runs of five words are
hashed; a window takes `window` runs in turn, so windows overlap by four words and every run lies in
exactly one. A window's band k is the smallest of its runs' hashes under the k-th seed. Templates store
each of their runs under each seed: a window that holds j runs of a template meets it in a band with
probability j / window, in one of `bands` with 1 - (1 - j / window) ** bands - 0.999 for a single run
(Params.collision). What is retrieved is verified: the share of the template's runs in the text around the
window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: License statements in common use, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ARR", "All rights reserved. No part of this publication may be reproduced"),
)


@dataclass(frozen=True)
class Params:
    words: int = 5
    window: int = 4
    bands: int = 24
    containment: float = 0.8
    #: Rows of band values, and templates, up to which they are broadcast; beyond that the joins shuffle.
    broadcast_rows: int = 1 << 20

    def collision(self, runs: int = 1) -> float:
        """The probability that a window that holds so many of a template's runs meets it in some band."""
        return 1 - (1 - min(runs, self.window) / self.window) ** self.bands


#: Marks that are dropped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}<>*#|/\\`_-+=%&$"


def word_list(text: Column) -> Column:
    """Lower-case words without the marks around them, so that quotes and full stops do not matter."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+")
    return F.array_remove(F.transform(words, lambda w: F.btrim(w, F.lit(MARKS))), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column by a generator: Spark merges projections, and would work `value` out anew for every
    window that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def runs(words: Column, n: int) -> Column:
    """Hashes of the runs of n words; none if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))


def smallest(band: Column, hashes: list[Column]) -> Column:
    """The smallest hash of a window's runs under the seed `band`; runs beyond the text's end are null, and the
    first one stands in for them."""
    values = [F.xxhash64(band, F.coalesce(h, hashes[0])) for h in hashes]
    return F.least(*values) if len(values) > 1 else values[0]


def template_table(spark: SparkSession, templates: tuple = TEMPLATES, params: Params | None = None) -> DataFrame:
    """template, license, runs: the distinct runs of each template. Shorter templates are refused."""
    p = params or Params()
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, statement string")
    out = rows.select("template", "license", F.array_distinct(runs(word_list(F.col("statement")), p.words)).alias("runs"), F.size(word_list(F.col("statement"))).alias("n_words"))
    short = out.where(F.size("runs") == 0).count()
    if short:
        raise ValueError(f"{short} templates have fewer than {p.words} words")
    return out


def scan(docs: DataFrame, templates: tuple = TEMPLATES, params: Params | None = None) -> DataFrame:
    """doc_id, license, n_places (windows that hold the statement), first_word, containment: a row for each
    document and license found; containment is the best over the license's templates.

    Null and empty texts, and texts of fewer than five words, hold no license. Repeated doc_ids are
    merged: places add up. An empty table gives no rows; extra columns, whatever their names, are not read.
    """
    p = params or Params()
    spark = docs.sparkSession
    known = template_table(spark, templates, p)
    seeds = F.sequence(F.lit(0), F.lit(p.bands - 1))
    wanted = known.select("template", F.explode("runs").alias("run")).select("template", F.explode(seeds).alias("its_band"), "run")
    wanted = wanted.select("template", "its_band", smallest(F.col("its_band"), [F.col("run")]).alias("value")).distinct()
    few = wanted.count() <= p.broadcast_rows
    sent = F.broadcast if few else lambda df: df  # checked, with another way beyond
    words = once(docs.select("doc_id", "text"), "words", word_list(F.col("text"))).select("doc_id", "words")
    texts = once(words, "runs", runs(F.col("words"), p.words)).where(F.size("runs") > 0).select("doc_id", "runs")
    # from here to the join all is generated code: a row per window, then one per band, met by a single long
    windows = texts.select("doc_id", "runs", F.explode(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(p.window))).alias("start"))
    hashes = [F.get("runs", F.col("start") + k).alias(f"h{k}") for k in range(p.window)]
    banded = windows.select("doc_id", "runs", "start", *hashes, F.explode(seeds).alias("band"))
    keys = banded.select("doc_id", "runs", "start", "band", smallest(F.col("band"), [F.col(f"h{k}") for k in range(p.window)]).alias("value"))
    found = keys.join(sent(wanted), "value").where("band = its_band").drop("band", "its_band", "value")
    # a template's other runs lie within its length before or after the window
    low = F.greatest(F.col("start") - F.col("n_words"), F.lit(0))
    around = F.slice("runs", low + 1, 2 * F.col("n_words") + p.window)
    share = F.size(F.array_intersect("runs_t", around)) / F.size("runs_t")
    whole = found.join(sent(known.withColumnRenamed("runs", "runs_t")), "template").select("doc_id", "license", "start", share.alias("containment"))
    places = whole.where(F.col("containment") >= p.containment).groupBy("doc_id", "license", "start").agg(F.max("containment").alias("containment"))
    return places.groupBy("doc_id", "license").agg(F.count("*").alias("n_places"), F.min("start").cast("long").alias("first_word"), F.max("containment").alias("containment"))
