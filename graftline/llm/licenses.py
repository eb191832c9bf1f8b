"""License scan by diagonal voting.

Every run of k words of every text is hashed and joined in Spark with the places such a run has in a library of license templates.  A
match at word p of the text and word q of the template votes for the diagonal p - q, the place where the template would begin.  Votes
are added up by diagonal, diagonals at most `slack` apart (words put in or left out) merge into one span, and a span is verified by
the share of the template's words that its votes cover, each vote being k equal words in place.

Short phrases are templates like any other, with k = 2: a diagonal that has all votes of a phrase is a place where it stands.

The join is against a broadcast table whose size is a parameter of the caller (the library; refused beyond `most` places), so texts
are not shuffled: only votes are, combined first.  One text's votes are bounded by its length; nothing is grouped by anything wider.

Cases: a null text counts as empty (no words, no labels, score 0); repeated rows come out as often as they went in; equal ids with
different texts stay apart; further columns are left aside; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from graftline.llm.rows import quoted, small_batches, text_slices
from graftline.llm.words import words

#: Phrases whose every place counts, with their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Notices and opening passages of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of a run, for phrases and for templates; share of a template that verifies a span; largest gap of merged diagonals; largest library.
K_PHRASE, K, COVER, SLACK, MOST = 2, 3, 0.75, 4, 200_000
COUNTS = -1  # marks the row that carries a text's number of words


def library_places(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, place, k, size, label, phrase): every run of words of the library."""
    rows = []
    for n, (label, text) in enumerate([*phrases, *templates]):
        phrase = n < len(phrases)
        k = K_PHRASE if phrase else K
        w = words([text.encode()])
        grams, at = w.window(k)
        if not len(grams):
            raise ValueError(f"a template of fewer than {k} words: {text}")
        rows += [(int(np.int64(np.uint64(g).view(np.int64))), n, int(q), k, len(w.hashes), label, phrase) for g, q in zip(_salted(grams, k), at, strict=True)]
    if len(rows) > MOST:
        raise ValueError(f"{len(rows)} places in the template library; at most {MOST} are broadcast")
    rows.append((COUNTS, COUNTS, 0, 0, 0, "", False))
    return spark.createDataFrame(rows, "gram long, template int, place int, k int, size int, label string, phrase boolean")


def _salted(grams: np.ndarray, k: int) -> np.ndarray:
    """Runs of different lengths never meet; the mark of the counts is left free."""
    h = grams ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return np.where(h == np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), h)


def rolling_grams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, at, gram): all rolling runs of both lengths of every text, and one row with its number of words."""
    slim = small_batches(df).select(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("text_key"), quoted(text_col))
    schema = StructType([slim.schema["id"], slim.schema["text_key"], StructField("at", IntegerType()), StructField("gram", LongType())])

    def run(batches):
        for batch in batches:
            for start, n, data in text_slices(batch.column(2)):
                w = words(data)
                text, at, gram = [np.arange(n)], [np.diff(w.first)], [np.full(n, COUNTS, np.int64)]
                for k in (K_PHRASE, K):
                    h, first = w.window(k)
                    text.append(w.text[first])
                    at.append(first - w.first[w.text[first]])
                    gram.append(_salted(h, k).view(np.int64))
                rows = pa.array(np.concatenate(text) + start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(gram))], ["id", "text_key", "at", "gram"])

    return slim.mapInArrow(run, schema)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, cover: float = COVER) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word (places of the phrases), base_labels, labels, score and spans.

    A span is (label, first_word, end_word, score), places counted in words from 0; score is the best span's, 0 if there is none."""
    places = library_places(df.sparkSession, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    hits = rolling_grams(df, id_col, text_col).join(F.broadcast(places), "gram")
    by = ["id", "text_key", "template", "label", "phrase", "k", "size"]
    diagonals = hits.groupBy(*by, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("n"), F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    # diagonals of one template in one text: at most as many as the text has words
    before = F.lag("diagonal").over(Window.partitionBy("id", "text_key", "template").orderBy("diagonal"))
    apart = F.when(F.col("phrase") | before.isNull() | (F.col("diagonal") - before > SLACK), 1).otherwise(0)
    numbered = diagonals.withColumn("new", apart).withColumn("span", F.sum("new").over(Window.partitionBy("id", "text_key", "template").orderBy("diagonal")))
    spans = numbered.groupBy(*by, "span").agg(F.max("n").alias("n"), F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("first"), (F.max("last") + F.first("k")).alias("end"), F.min("diagonal").alias("diagonal"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    scored = spans.withColumn("score", F.when(F.col("size") > 0, covered / F.col("size")).otherwise(0.0))
    good = (F.col("template") != COUNTS) & (F.col("score") >= F.when(F.col("phrase"), 1.0).otherwise(cover))
    base = F.col("phrase") & good
    found = F.struct("label", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "score")
    per_text = scored.groupBy("id", "text_key").agg(
        F.max(F.when(F.col("template") == COUNTS, F.col("n"))).alias("copies"), F.max(F.when(F.col("template") == COUNTS, F.col("diagonal"))).cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"), F.collect_set(F.when(base, F.col("label"))).alias("base"),
        F.collect_set(F.when(good, F.col("label"))).alias("all"), F.coalesce(F.max(F.when(good, F.col("score"))), F.lit(0.0)).alias("score"), F.sort_array(F.collect_list(F.when(good, found))).alias("spans"))
    joined = lambda c: F.concat_ws(",", F.sort_array(c))
    return (per_text.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"), "score", "spans"))
