"""Exact duplicates by distributed most-significant-digit radix partitioning; equality needs no digest.

All texts start in one group. A round splits every group by its texts' next bytes (a digit); groups of one are done,
groups whose texts have ended hold equal texts, and the rest go on with the next, wider digit. The rounds are as many
as the logarithm of the longest repeated text, and only texts that still share all their bytes with another move on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_or_empty

FIRST_DIGIT, GROWTH, WIDEST = 64, 16, 1 << 20  # bytes


def normalised(text: Column) -> Column:
    """Each ``[\\x20\\x09-\\x0D]+`` as one space; single spaces are left alone, which gives the same."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal when they are after white-space normalisation; a null text is empty. The row with the smallest
    doc_id stays (null ids last; of rows with the same id, one). The SHA-256 is only returned, never compared.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).cast("binary").alias("text"))
    # the row number is fixed once written; repeated doc_ids stay apart by it
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), "text"), "radix")
    open_, ended, width = rows.select("row", "doc_id", F.lit(0).cast("long").alias("group"), F.col("text").alias("rest")), [], first_digit
    while True:
        digit = F.substring("rest", 1, width)
        split = open_.select("row", "doc_id", "group", digit.alias("digit"), F.substring("rest", width + 1, 2**31 - 1).alias("rest"))
        first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        groups = (split.groupBy("group", "digit").agg(F.count("*").alias("size"), F.min(first).alias("first"), F.min("row").alias("next"))
                  .where("size > 1"))
        shared = stored(split.join(groups, ["group", "digit"]).select(
            "row", "doc_id", F.col("next").alias("group"), "size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
            (F.octet_length("digit") < width).alias("over"), "rest"), "radix")
        ended.append(shared.where("over").select("row", "size", "keep_id", "keep_row"))
        open_ = shared.where("not over").select("row", "doc_id", "group", "rest")
        if open_.isEmpty():
            break
        width = min(width * growth, widest)
    equal = reduce(DataFrame.unionAll, ended)
    alone = F.col("size").isNull()
    return rows.select("row", "doc_id", "text_sha256").join(equal, "row", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")
