"""Connected components of an edge table by alternating large and small stars; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v): every node links its neighbours to the smallest of them and itself; a large star only those
    larger than itself, a small star only the smaller ones and itself. Hot nodes are pre-aggregated, and met by a plain
    equi-join that can be split."""
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(least, "u")
    if large:
        linked = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def component_roots(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (u, v) but the roots themselves."""
    edges, before = stored(edges.where("u <> v").select("u", "v").distinct(), name), None
    for _ in range(ROUNDS):
        edges = stored(_stars(_stars(edges, True), False), name)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
