"""License scans by diagonal voting, with DataFrame functions only.

Words are hashed two by two along every text; the hashes that a template has are
joined to its places.  A hit at word p of a text and place q of a template votes
for the diagonal p - q: a template that stands in the text word for word puts all
its votes on one diagonal.  Neighbouring diagonals, ``slack`` apart at most, are
merged, so that a word or two put in or left out do not split a license.  The
span that a merged group covers is verified by its words: a license is one whose
template's words are at least ``cover`` of the span.  Every vote is verified by its
two words, so a base phrase counts exactly where its words stand.

The joined side is the template table, a constant of this module.  A text is read
once: its number of words and the places of its hits are written to the
checkpoint folder, and only they move.  Counts and votes of a row meet by
(doc_id, hash of the text).

Defined results for odd input: a null or empty text has no words and no labels
(empty strings), score 0 and null places; rows with an equal doc_id are scanned
each for itself, and repeated rows give repeated results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.components import cut_lineage

#: What parts words: runs of ASCII other than letters and digits. One by one, they make a table that Java looks up by index.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: The one sign beyond ASCII whose lower case is a lone ASCII letter, and a letter that has none and stands in for it.
KELVIN, OTHER_LETTER = "\u212a", "\u0138"
#: Phrases that count wherever they stand: (label, words). Fixed values.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Longer templates of the method's own, found in edited form too: (label, words).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Diagonals so far apart still merge.
SLACK = 2
#: Share of a span that the template's words must be.
COVER = 0.8


def template_pairs(spark: SparkSession) -> DataFrame:
    """(template, label, base, words, place, hash, one, two) of every word pair of every template."""
    rows = []
    for n, (label, text) in enumerate(BASE + TEMPLATES):
        words = text.split()
        rows += [(n, label, n < len(BASE), len(words), q, one, two) for q, (one, two) in enumerate(zip(words, words[1:], strict=False))]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, words int, place int, one string, two string")
    return made.withColumn("hash", F.xxhash64("one", "two"))


def words_in(text: Column) -> Column:
    """Words of a text with A-Z in lower case; ASCII words are exact, others may change case too."""
    return F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER_LETTER))), BETWEEN)


def scan_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, own, n_words, hits) of every row: the word pairs that templates have, with their places; one pass over the texts."""
    pairs = {(one, two) for _, phrase in BASE + TEMPLATES for one, two in zip(phrase.split(), phrase.split()[1:], strict=False)}
    known = [F.xxhash64(F.lit(one), F.lit(two)) for one, two in sorted(pairs)]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = rows.select("key", F.xxhash64("text").alias("own"), words_in(F.col("text")).alias("w"))
    # separators at either end leave an empty word there
    first, last = (F.element_at("w", 1) == "").cast("int"), ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    counted = split.select("key", "own", "w", first.alias("skip"), (F.size("w") - first - last).cast("long").alias("n_words"))
    tails = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    hashed = counted.select("*", F.zip_with("w", tails, lambda one, two: F.when(two.isNotNull(), F.xxhash64(one, two))).alias("h"))
    placed = hashed.select("*", F.filter(F.transform("h", lambda x, i: F.when(x.isin(*known), i)), lambda i: i.isNotNull()).alias("at"))
    hit = lambda i: F.struct((i - F.col("skip")).alias("p"), F.get("h", i).alias("hash"), F.get("w", i).alias("one"), F.get("w", i + 1).alias("two"))
    return placed.select("key", "own", "n_words", F.transform("at", hit).alias("hits"))


def scan_licenses(docs: DataFrame, slack: int = SLACK, cover: float = COVER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    scanned = cut_lineage(scan_words(docs, key, text))
    hits = scanned.select("key", "own", F.inline("hits"))
    votes = hits.join(F.broadcast(template_pairs(docs.sparkSession)), ["hash", "one", "two"])

    # votes of each diagonal, then of each with its neighbours: the span from its first word to its last
    row = ["key", "own", "template", "label", "base", "words"]
    diagonals = votes.groupBy(*row, (F.col("p") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    near = Window.partitionBy("key", "own", "template").orderBy("diagonal").rangeBetween(0, slack)
    merged = diagonals.withColumn("span", F.flatten(F.collect_list("places").over(near)))
    covered = F.size(F.array_distinct(F.concat("span", F.transform("span", lambda q: q + 1))))
    length = F.col("words") + F.max("diagonal").over(near) - F.col("diagonal")  # of the span, with the words put in
    merged = merged.withColumns({"share": covered / length, "whole": F.size("places") == F.col("words") - 1})
    counted = F.col("base") & F.col("whole")
    named = F.when(F.col("base"), F.col("whole")).otherwise(F.col("share") >= cover)
    found = merged.groupBy("key", "own").agg(
        F.count_if(counted).alias("n_base"),
        F.min(F.when(counted, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(counted, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(counted, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    counts = scanned.select("key", "own", "n_words")
    same = counts["key"].eqNullSafe(found["key"]) & (counts["own"] == found["own"])
    return counts.join(found, same, "left").select(
        counts["key"].alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
