"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text is joined to the positions of the same k-gram in the templates. Hits
are grouped by (document, template, diagonal); a diagonal keeps the template positions it has met as a bit
set, so repeated rows change nothing. Neighbouring diagonals (words added or left out) merge, and a merged
span counts when it covers enough of its template within a bounded length.

The templates are fixed and few (they are checked against a size limit), so that side is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .native import blank_split, letters_and_digits, once, phrase_starts, rolling

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "licensed under CC BY 4.0",
        "available under the terms of CC BY-SA 4.0",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["Copyright. All rights reserved."],
}


def template_grams(spark: SparkSession, templates: dict[str, list[str]], k: int) -> DataFrame:
    """label, template, n_grams, tpos and g of each template; a template holds up to 63 k-grams."""
    rows = [(label, f"{label}/{i}", t) for label, ts in templates.items() for i, t in enumerate(ts)]
    for _, name, t in rows:
        n = len(re.findall(r"[0-9a-z]+|[^\x00-\x7f]+", t.lower())) - k + 1
        if not 1 <= n <= 63:
            raise ValueError(f"template {name} has {n} k-grams; 1 to 63 are possible")
    if len(rows) > 5_000:
        raise ValueError("too many templates to broadcast")
    words = spark.createDataFrame(rows, "label string, template string, text string").select("label", "template", once(blank_split(letters_and_digits(F.col("text")))).alias("words"))
    grams = words.select("*", once(rolling("words", k)).alias("gs"))
    return grams.select("label", "template", F.size("gs").alias("n_grams"), F.posexplode("gs").alias("tpos", "g"))


def scan(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    k: int = 3,
    key: str = "doc_id",
    text: str = "text",
    min_cover: float = 0.75,
    drift: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: counts and labels of the phrases, labels of the verified spans, score, spans.

    A null text has no words. Repeated rows give equal rows, an empty table gives no rows, extra columns are
    ignored, and a null key is a key. The score is 1 where a phrase stands, else the best cover of a template
    by one merged span, 0 where no k-gram is met.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    base = base.select("doc_id", F.xxhash64("t").alias("h"), letters_and_digits(F.col("t")).alias("joined"))
    words = base.select("*", once(blank_split(F.col("joined"))).alias("words"))

    grams = F.broadcast(template_grams(spark, templates or TEMPLATES, k))
    hits = words.select("doc_id", "h", rolling("words", k).alias("gs")).select("doc_id", "h", F.posexplode("gs").alias("pos", "g"))
    hits = hits.join(grams, "g").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    spot = ["doc_id", "h", "label", "template", "n_grams"]
    votes = hits.groupBy(*spot, "diagonal").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tpos"))).alias("met"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    w = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    runs = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > drift).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy(*spot, "run").agg(F.bit_or("met").alias("met"), F.min("first").alias("first"), (F.max("last") + k).alias("end"))
    spans = spans.withColumn("cover", F.bit_count("met") / F.col("n_grams"))
    short = F.col("end") - F.col("first") <= 2 * (F.col("n_grams") + k)
    spans = spans.withColumn("verified", (F.col("cover") >= min_cover) & short)
    found = spans.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("own"),
        F.max(F.when(short, F.col("cover"))).alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("verified"), F.struct("first", "end", "template", "cover")))).alias("spans"),
    )

    starts = {p: f"s{i}" for i, p in enumerate(PHRASES)}
    counted = words.select(
        "doc_id", "h", F.size("words").cast("long").alias("n_words"), *(phrase_starts("joined", "words", p).alias(s) for p, s in starts.items())
    )
    every = F.concat(*starts.values())
    counted = counted.select(
        "doc_id", "h", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(starts[p]) > 0, F.lit(label)) for p, label in PHRASES.items()))).alias("base"),
    )
    both = counted.alias("c").join(found.alias("f"), F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.h") == F.col("f.h")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("c.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )
