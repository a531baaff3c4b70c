"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame functions only.

A text's words are hashed; a window is WINDOW word shingles (of five words), and one starts every STEP shingles, so each shingle
stands in WINDOW / STEP windows. A band is one MinHash of a window: the least of its shingle hashes after a rotation and mask of the
band's own. Templates' windows start at every shingle. For a window that shares j of its shingles with a template's window of the
same extent, a band agrees with a chance of about j / WINDOW at least, so a template is retrieved with a chance of

    1 - (1 - j / WINDOW) ** (BANDS * windows that hold it)

which is 0.96 for one window and a template of a single shingle (0.998 for its two), 0.999 for two shingles, and 1 where a
whole window agrees. Texts with a candidate are read again: every shingle of theirs that the candidate template has is placed, places
with no gap above GAP + a quarter of the template form a match, and it holds if its different shingles are at least CONTAINMENT of the
template's.

Defined results: null, empty and short texts (under five words) have no match; templates of under five words are refused; rows with a null id
take no part; repeated rows (equal id and text) give their matches once. No match: no row.

The steps' tables and the result are short beside the texts and go to at most a file per core, however many partitions a shuffle
has: for each file that it creates on a local disk without its native library, Hadoop starts processes from the executor.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import let, read_table, staged

SHINGLE, WINDOW, STEP, BANDS, CONTAINMENT, GAP = 5, 8, 4, 24, 0.8, 8
#: Lists of candidate texts, and template tables, are broadcast up to this many rows (32 bytes each); longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Notices by which texts state their license. The licenses' own words.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _word_hashes(text: Column) -> Column:
    """Hashes of a text's lower-cased words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _windows(df: DataFrame, keys: list[str], text: Column, step: int) -> DataFrame:
    """keys, at (first shingle) and the shingle hashes s0, s1 ... (null past the end) of each window."""
    extent = WINDOW + SHINGLE - 1

    def starts(hashes: Column) -> Column:
        n = F.size(hashes) - SHINGLE + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(i.alias("at"), F.slice(hashes, i + 1, extent).alias("w"))))

    rows = df.select(*keys, F.explode(let(_word_hashes(text), starts)).alias("v")).select(*keys, F.col("v.at").alias("at"), F.col("v.w").alias("w"))
    shingle = lambda j: F.when(F.size("w") >= j + SHINGLE, F.xxhash64(*(F.get("w", j + k) for k in range(SHINGLE))))
    return rows.select(*keys, "at", *(shingle(j).alias(f"s{j}") for j in range(WINDOW)))


def _bands(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a band value for each window and band."""
    mask = F.col("mask")
    seen = windows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("mask", F.xxhash64("b"))
    # Column-valued shifts: SQL has them, the Python functions take constants only
    turned = [F.expr(f"(shiftleft(s{j}, (b * 29) % 64) | shiftrightunsigned(s{j}, 64 - (b * 29) % 64)) ^ mask") for j in range(WINDOW)]
    return seen.select(*keys, F.least(*turned).bitwiseXOR(F.shiftleft(mask, 1)).alias("band"))


def _sized(df: DataFrame) -> DataFrame:
    """df, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan(docs: DataFrame, templates=TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, start_word, end_word (exclusive), shingles found, of how many, containment: a row per verified match."""
    spark = docs.sparkSession
    files = spark.sparkContext.defaultParallelism
    rows = [{"template": k, "license": n, "notice": t} for k, (n, t) in enumerate(templates)]
    names = spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("template", pa.int32()), ("license", pa.string()), ("notice", pa.string())])))  # from Arrow, as lists go through Python workers
    shingles = staged(_windows(names, ["template", "license"], F.col("notice"), 1).select("template", "license", F.col("s0").alias("shingle")).distinct().coalesce(files), "templates")
    sizes = shingles.groupBy("template").agg(F.count("*").alias("of"))
    if sizes.count() < len(templates):
        raise ValueError("a template needs five words")
    bands = staged(_bands(_windows(names, ["template"], F.col("notice"), 1), ["template"]).distinct().coalesce(files), "bands")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = _bands(_windows(text.withColumn("digest", F.xxhash64("text")), ["doc_id", "digest"], F.col("text"), STEP), ["doc_id", "digest"])
    candidates = staged(found.join(_sized(bands), "band").select("doc_id", "digest", "template").distinct().coalesce(files), "candidates")
    chosen = candidates.groupBy("doc_id", "digest").agg(F.collect_set("template").alias("templates"))
    again = text.withColumn("digest", F.xxhash64("text")).join(_sized(chosen), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])

    def placed(hashes: Column) -> Column:
        n = F.size(hashes) - SHINGLE + 1
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE))))

    at = again.select("doc_id", "digest", "templates", F.posexplode(let(_word_hashes(F.col("text")), placed)).alias("at", "shingle"))
    hits = at.join(_sized(shingles), "shingle").where(F.array_contains("templates", F.col("template"))).join(F.broadcast(sizes) if len(templates) <= BROADCAST_ROWS else sizes, "template")
    text_order = Window.partitionBy("doc_id", "digest", "template").orderBy("at")
    far = F.col("at") - F.lag("at").over(text_order) > GAP + F.col("of") / 4
    runs = hits.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(text_order))
    matches = runs.groupBy("doc_id", "digest", "template", "license", "of", "run").agg(F.min("at").alias("start_word"), (F.max("at") + SHINGLE).alias("end_word"), F.size(F.collect_set("shingle")).alias("shingles"))
    held = matches.where(F.col("shingles") >= F.lit(containment) * F.col("of")).select("doc_id", "license", "start_word", "end_word", "shingles", F.col("of").cast("int").alias("of"), (F.col("shingles") / F.col("of")).alias("containment"))
    return held.repartition(files)  # not coalesce: the texts are read again in as many tasks as before


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return scan(read_table(spark, sf_dir, "documents"))
