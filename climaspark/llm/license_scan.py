"""License scans by diagonal voting: rolling word k-gram hashes joined to template positions, votes counted by offset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, by_size, shingle_hashes, small_batches, word_hashes

# Phrases whose every place counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices of well-known licenses, and the method's own labels for them.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
PHRASE_GRAM, GRAM = 2, 4
#: Diagonals this near are one occurrence with words put in or left out; a span is verified when so much of the template is there.
NEIGHBOURS, COVERED = 2, 0.6
#: A template of fewer k-grams must be there whole: its last word may tell two licenses apart.
SHORT = 12


def _table() -> list[tuple[int, int, bool, str, int, int]]:
    """(hash, template, is a phrase, label, position, number of k-grams): a row for each k-gram of each template; a few hundred rows."""
    rows = []
    for number, (text, label, phrase) in enumerate([*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for t, x in TEMPLATES.items())]):
        words, at = word_hashes([text])
        grams = shingle_hashes(words, at, PHRASE_GRAM if phrase else GRAM)[0]
        rows += [(int(h), number, phrase, label, i, len(grams)) for i, h in enumerate(grams.view(np.int64))]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_table(), "hash long, template int, phrase boolean, label string, at int, grams int")


GRAMS = "row long, doc_id long, n_words long, two array<long>, four array<long>"


def rolling(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, two, four): every text's rolling 2-gram and 4-gram hashes in order. row numbers the input rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, done = batch.column(0), 0
            for texts in by_size(batch.column(1).to_pylist()):
                words, at = word_hashes(texts)
                grams = []
                for k in (PHRASE_GRAM, GRAM):
                    found, first = shingle_hashes(words, at, k)
                    # A text of fewer words than k has no k-gram.
                    n, short = np.diff(first), np.diff(at) < k
                    keep = ~np.repeat(short, n)
                    grams.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(short, 0, n))), pa.int32()), pa.array(found[keep].view(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), ids.slice(done, len(texts)), pa.array(np.diff(at)), *grams], ["row", "doc_id", "n_words", "two", "four"])
                row, done = row + len(texts), done + len(texts)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bounded(run), GRAMS)


def votes(docs: DataFrame) -> DataFrame:
    """A row for each document, template and offset diagonal with the template's positions that voted for it; documents without a vote have one null row.

    All k-grams meet the templates' positions, a few hundred rows, by a broadcast join, and what meets none goes before the shuffle.
    """
    one = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("hash")))
    hits = F.concat(one, *(F.transform(c, lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))) for c in ("two", "four")))
    rows = rolling(docs).select("row", "doc_id", "n_words", F.explode(hits).alias("hit")).select("row", "doc_id", "n_words", "hit.pos", "hit.hash")
    joined = rows.join(F.broadcast(templates(docs.sparkSession)), "hash", "left").where("template is not null or pos < 0").withColumn("diagonal", F.col("pos") - F.col("at"))
    return joined.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(
        F.first("phrase").alias("phrase"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.count("at").alias("votes"), F.min("pos").alias("begin"), F.max("pos").alias("last"), F.collect_set("at").alias("positions")
    )


def spans(docs: DataFrame) -> DataFrame:
    """Occurrences: neighbouring diagonals of one template, merged, with the share of the template that they cover.

    A phrase's diagonals are never merged. `verified`: all of a phrase or short template is there, or enough of a longer one
    within one and a half times its length.
    """
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.when(F.col("phrase") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS), 1).otherwise(0)
    island = votes(docs).withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("row", "doc_id", "n_words", "template", "island").agg(
        F.first("phrase").alias("phrase"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.min("begin").alias("begin"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("covered")
    )
    share = F.col("covered") / F.col("grams")
    whole = F.when(F.col("phrase") | (F.col("grams") < SHORT), F.col("covered") == F.col("grams")).otherwise((share >= COVERED) & (F.col("last") - F.col("begin") + GRAM <= 1.5 * (F.col("grams") + GRAM)))
    return merged.withColumn("share", share).withColumn("verified", F.coalesce(whole, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of (doc_id, text): counts and places of the phrases, labels and a score of 0 to 1, the best covered share.

    Null texts are empty: no words, no labels, score 0. Repeated rows are scanned each for itself.
    """
    base = F.col("verified") & F.col("phrase")

    def labels(which):
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    out = spans(docs).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("begin"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("phrase") & ~F.col("verified"), F.lit(0.0)).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
