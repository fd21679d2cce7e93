"""Top-k per group, latest per key and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group with their 1-based ``rank``.

    The ``rank <= k`` filter over ``row_number`` makes Spark put a group limit below the shuffle, so a
    hot group sends at most k rows per map task instead of all of them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key by ``order``: a partial aggregate, not a window, so keys may be hot."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def reciprocal_rank_fusion(
    *channels: DataFrame, keys: Sequence[str], item: Sequence[str], k: int = 60, n: int | None = None
) -> DataFrame:
    """Sum of ``1 / (k + rank)`` over the channels; each channel has keys, item columns and ``rank``."""
    cols = [*keys, *item, "rank"]
    merged = channels[0].select(*cols)
    for channel in channels[1:]:
        merged = merged.unionByName(channel.select(*cols))
    fused = merged.groupBy(*keys, *item).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    # ranking on the rounded score keeps ties independent of the order of summation
    fused = fused.withColumn("score", F.round("score", 9))
    order = [F.col("score").desc(), *[F.col(c) for c in item]]
    return top_per_group(fused, keys, order, n or 2**31 - 2)
