"""Table mutations as pure functions and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ranking import latest_per_key


def without_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``other`` does not hold; null keys are equal to each other."""
    names = {k: f"_held_{k}" for k in keys}
    held = other.select(*[F.col(k).alias(n) for k, n in names.items()])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(held, reduce(lambda a, b: a & b, same), "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Insert or replace by key, null keys included.

    ``order`` says which of several new rows of a key is the last; without it, or among equals, the row that is
    largest by its values is taken, so that one row per key comes in.
    """
    rest = [c for c in old.columns if c not in keys]
    fresh = latest_per_key(new, list(keys), [*([order] if order else []), *rest]) if rest else new.select(*keys).distinct()
    return without_keys(old, fresh, keys).unionByName(fresh.select(*old.columns))


def upsert_guarded(old: DataFrame, new: DataFrame, articles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace a derived row only when the new one was made from the article's current content.

    Absent keys are inserted whatever their hash, like an insert that meets no conflict.
    """
    current = articles.select("article_id", F.col("content_hash").alias("current_hash"))
    current_ones = new.join(current, "article_id").where(F.col("content_hash") == F.col("current_hash")).select(*new.columns)
    return upsert_latest(old, current_ones.unionByName(without_keys(new, old, keys)).distinct(), keys)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds new keys, null keys included; of several new rows of a key the smallest by its values comes in."""
    rest = [c for c in old.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else new.select(*keys).distinct()
    return old.unionByName(without_keys(first, old, keys).select(*old.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key or key).alias(key)), key, "left_semi")


def null_missing(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Weak reference: set to null where the parent is gone."""
    ids = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("_held"))
    joined = children.join(ids, key, "left")
    return joined.withColumn(key, F.when(F.col("_held"), F.col(key))).select(*children.columns)


def duplicates(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("violations")).select(F.lit(f"unique:{name}").alias("check_name"), "violations")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    lost = df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(f"fk:{name}").alias("check_name"), "violations")


def outside(df: DataFrame, condition, name: str) -> DataFrame:
    """Rows for which ``condition`` does not hold."""
    bad = df.where(~F.coalesce(condition, F.lit(False)))
    return bad.agg(F.count("*").alias("violations")).select(F.lit(f"check:{name}").alias("check_name"), "violations")


def violations(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out
