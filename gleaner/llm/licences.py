"""Licence notices by diagonal voting: word k-grams of documents and templates meet by rolling hash.

A shared k-gram votes for the diagonal on which the template would begin. Votes are summed per diagonal, neighbouring
diagonals (words put in or left out) are merged, and a merged span counts when a stretch of at most twice the template's
words holds enough of the template; every stretch of a longer span is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import text_or_empty, words_of

K = 2  # words of a gram: the shortest phrase to be found
GAP = 4  # neighbouring diagonals, in words
COVERED = 0.7  # of a template's words, for its label

# The contract's phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Notices as their licences word them.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
]


def with_labels(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, covered: float = COVERED,
                gap: int = GAP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``phrases`` count at every place where all their words stand; ``notices`` add their label where a stretch of a merged
    span holds ``covered`` of their words. ``score`` is the largest share of a phrase or notice found: 1 for a whole one, 0 for
    none. Null texts have no words. Both lists are constants of the job, so their grams are broadcast.
    """
    spark = docs.sparkSession
    listed = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    templates = spark.createDataFrame(listed, "template int, body string, label string, base boolean").withColumn("have", words_of(F.col("body")))
    grams = templates.select("template", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("have") - K), lambda i: F.slice("have", i + 1, K))).alias("at", "words"))
    grams = F.broadcast(grams.select(F.xxhash64("words").alias("hash"), "template", "at", F.col("words").alias("expected")))
    info = F.broadcast(templates.select("template", "label", "base", F.size("have").alias("m")))

    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text_or_empty()).alias("key"), words_of(text_or_empty()).alias("have"))
    rolled = F.transform(F.sequence(F.lit(0), F.size("have") - K), lambda i: F.struct(F.xxhash64(F.slice("have", i + 1, K)).alias("hash"), F.slice("have", i + 1, K).alias("words")))
    votes = (numbered.where(F.size("have") >= K).select("id", "key", F.posexplode(rolled).alias("i", "gram"))
             .join(grams, F.col("gram.hash") == F.col("hash")).where(F.col("gram.words") == F.col("expected"))
             .select("id", "key", "template", "at", "i").distinct())
    diagonals = votes.groupBy("id", "key", "template", (F.col("i") - F.col("at")).alias("diag")).agg(
        F.count("*").alias("votes"), F.min("i").alias("low"), F.max("i").alias("high"), F.collect_set("at").alias("places"))
    order = Window.partitionBy("id", "key", "template").orderBy("diag")
    apart = (F.col("diag") - F.lag("diag").over(order) > gap).cast("int")
    chain = Window.partitionBy("id", "key", "template", "span")
    reach = 2 * F.col("m") - K + 1  # first words of grams that fit a stretch of twice the template
    block = lambda word: F.floor(word / reach)
    # a chain that fits one stretch is a group; a longer one is dealt to blocks, each with the one after it, so that every stretch is in a block
    chained = (diagonals.join(info, "template").withColumn("span", F.when(F.col("base"), F.col("diag")).otherwise(F.sum(F.coalesce(apart, F.lit(0))).over(order)))
               .withColumn("long", F.max("high").over(chain) - F.min("low").over(chain) >= reach)
               .withColumn("block", F.explode(F.when(F.col("long"), F.sequence(F.greatest(block(F.col("low")) - 1, F.lit(0)), block(F.col("high")))).otherwise(F.array(F.lit(0).cast("long"))))))
    merged = chained.groupBy("id", "key", "template", "label", "base", "m", "span", "long", "block").agg(
        F.min("low").alias("low"), F.collect_list(F.struct("diag", "places")).alias("parts"))
    pairs = F.flatten(F.transform("parts", lambda d: F.transform(d["places"], lambda p: F.struct((d["diag"] + p).alias("i"), p.alias("at")))))
    words = lambda these: F.size(F.array_distinct(F.flatten(F.transform(these, lambda v: F.array(*[v["at"] + k for k in range(K)])))))
    starts = F.filter(F.array_distinct(F.transform("pairs", lambda v: v["i"])), lambda i: block(i) == F.col("block"))
    best = F.array_max(F.transform(starts, lambda i: words(F.filter("pairs", lambda v: (v["i"] >= i) & (v["i"] < i + reach)))))
    spans = merged.withColumn("pairs", pairs).withColumn("share", F.when(F.col("long"), best).otherwise(words(F.col("pairs"))) / F.col("m"))
    whole = F.col("base") & (F.col("share") == 1)
    taken = F.when(F.when(F.col("base"), F.col("share") == 1).otherwise(F.col("share") >= covered), F.col("label"))
    found = spans.groupBy("id", "key").agg(
        F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("low"))).alias("first_word"), F.max(F.when(whole, F.col("low"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(whole, F.col("label")))).alias("base"), F.sort_array(F.collect_set(taken)).alias("all"), F.max("share").alias("score"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                      F.xxhash64(text_or_empty()).alias("key"), F.size(words_of(text_or_empty())).cast("long").alias("n_words"))
    joined = lambda c, name: F.coalesce(F.array_join(c, ","), F.lit("")).alias(name)
    return own.join(found, ["id", "key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), joined("base", "base_labels"), joined("all", "labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
