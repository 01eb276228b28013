"""License scans by diagonal voting. Built-in functions only.

All rolling word k-grams of the texts are joined by hash to the places where they
stand in the templates. A hit at word p of a text and place t of a template votes
for the diagonal p - t, which is where the template would begin. A phrase of the base
stands in a text where one diagonal has all of its k-grams. Longer templates may be
quoted with words put in or left out, which shifts the diagonal: neighbouring
diagonals are merged to a span, and the span is verified by the share of the
template's words that its hits cover, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import join_groups
from cohortry.sources.scratch import settle

#: Words of a k-gram; no phrase of the base has fewer.
GRAM = 3
#: Words by which neighbouring diagonals of one span differ at most.
SHIFT = 4
#: Share of a template's words that a span must cover.
LEAST_COVER = 0.7

# The base's phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"),
        ("cc-by-nc", "cc by nc"))

# Wordings by which well-known licenses are stated.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
            "to whom the Software is furnished to do so"),
    ("mit", "released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
                 "this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms "
              "of the GNU General Public License as published by the Free Software Foundation, either "
              "version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before A to Z are made small: digits, letters, and all beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as they stand in it; none of a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def small(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def grams(rows: DataFrame, words: str, k: int = GRAM) -> DataFrame:
    """``rows`` without the words, one row per k-gram: at (its first word), gram and
    hash. The hash is of all small letters, so it also joins what only ``small``
    tells apart; a hit compares the grams themselves."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k))
    each = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
    kept = [F.col(c) for c in rows.columns if c != words]
    return rows.select(*kept, F.posexplode(each).alias("at", "gram")).withColumn(
        "hash", F.xxhash64(F.lower("gram")))


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, label, exact, n_words, at, gram, hash): as many rows as the
    templates have words, hence small enough for a broadcast at any size of input."""
    listed = [(i, label, text, i < len(base)) for i, (label, text) in enumerate([*base, *templates])]
    table = spark.createDataFrame(listed, "template int, label string, text string, exact boolean")
    words = table.select("template", "label", "exact", words_of(small(F.col("text"))).alias("words"))
    return grams(words.withColumn("n_words", F.size("words")), "words", k)


def hits(docs: DataFrame, templates: DataFrame, carried: list[str], words: str = "words") -> DataFrame:
    """(carried, template, label, exact, n_words, place, diagonal): k-grams of the
    texts that stand in a template, word for word."""
    known = templates.select("template", "label", "exact", "n_words", F.col("at").alias("place"),
                             F.col("gram").alias("known"), "hash")
    found = grams(docs.select(*carried, words), words).join(F.broadcast(known), "hash")
    return found.where(small(F.col("gram")) == F.col("known")).select(
        *carried, "template", "label", "exact", "n_words", "place",
        (F.col("at") - F.col("place")).alias("diagonal"))


def spans(found: DataFrame, carried: list[str], k: int = GRAM, shift: int = SHIFT) -> DataFrame:
    """Per merged run of neighbouring diagonals: first_word, and cover, the share of
    the template's words that its hits cover, and copies, the rows that repeat it.

    Diagonals of phrases of the base are not merged. All work is per row and
    template, so no group exceeds the hits of one text.
    """
    group = [*carried, "template", "label", "exact", "n_words"]
    once = found.groupBy(*group, "diagonal", "place").agg(F.count(F.lit(1)).alias("copies"))
    lines = once.groupBy(*group, "diagonal").agg(
        F.collect_set("place").alias("places"), F.max("copies").alias("copies"))
    order = Window.partitionBy(*carried, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.lit(shift)
    begins = F.coalesce(F.col("exact") | apart, F.lit(True))
    runs = lines.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    merged = runs.groupBy(*group, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"),
        F.max("copies").alias("copies"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "places", lambda p: F.sequence(p, p + F.lit(k - 1))))))
    return merged.select(*group, "first_word", "copies", (covered / F.col("n_words")).alias("cover"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 least_cover: float = LEAST_COVER, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of
    every row.

    Words are runs of digits, letters and characters beyond ASCII, with A to Z made
    small. n_base counts all places where a phrase of the base stands, first_word and
    last_word are the smallest and largest of their first words. Labels add those of
    templates that a span covers by ``least_cover`` or more; both are distinct, sorted
    and joined by commas, and empty where there are none. The score is the largest
    cover among the labels, 1 for the base, 0 without labels. Null text counts as
    empty. Rows that repeat id and text get the same result each. Ids may be null.
    Other columns play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # Rows of equal id and text have equal results, so the pair can name a row.
    named = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
                        words_of(F.col(text)).alias("words"))
    carried = ["doc_id", "text_hash"]
    found = spans(hits(named, template_grams(spark, base, templates), carried), carried)
    kept = found.where(F.when(F.col("exact"), F.col("cover") >= 1).otherwise(F.col("cover") >= least_cover))
    in_base = F.when(F.col("exact"), F.col("first_word"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.col("text_hash").cast("string")).alias("name")
    results = settle(kept.groupBy(*carried).agg(
        F.count(in_base).alias("n_base"), F.min(in_base).cast("bigint").alias("first_word"),
        F.max(in_base).cast("bigint").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"), F.max("cover").alias("score"), F.max("copies").alias("copies"),
        ).select(name, "n_base", "first_word", "last_word", "base_labels", "labels", "score", "copies"))
    rows = settle(named.select("doc_id", name, F.size("words").cast("bigint").alias("n_words")))
    none = F.lit("")
    return join_groups(rows, results, "name", "copies", rows.count()).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word",
        "last_word", F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
