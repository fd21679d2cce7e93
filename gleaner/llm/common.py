"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_folder

NO_ID = -(1 << 63)  # stands for a null doc_id in joins
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word of the licence and contamination contracts, written as what stands between words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared scratch folder and read again: lineage ends, columns can be pruned."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII alone take the fast path with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in order."""
    return F.filter(F.split(ascii_lower(text), NO_WORD), lambda w: w != "")


def matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` as a struct ``row``, joined to ``found`` (did, dkey, ...) by id and hash of the text.

    In a struct, columns of ``docs`` cannot clash with others; null and repeated ids are safe.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at_id"), F.xxhash64(text_or_empty()).alias("at_key"))
    return rows.join(found, (F.col("at_id") == F.col("did")) & (F.col("at_key") == F.col("dkey")), how)
