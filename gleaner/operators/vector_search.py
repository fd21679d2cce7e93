"""Nearest neighbours of a table of query vectors by an inverted file of cells.

Centroids are fitted on a bounded sample; every vector belongs to the cell of its nearest centroid. Queries and vectors
are DataFrames that meet by equi-join on the cell, both dealt in blocks of bounded size, so that neither a hot cell nor
a popular one is one task's. A query first asks its nearest cells, then every other cell that the angle to its centroid,
less the cell's radius, does not rule out against the k-th best found so far. That is exact; taking only a share of the
radius asks fewer cells and finds most of the neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import by_shuffle, cut_lineage
from .ranking import top_per_group

SAMPLE = 10_000  # vectors that the centroids are fitted on, about
CELLS = 1_024  # at most
PROBES = 4  # cells that a query asks first
BLOCK_ROWS = (2_048, 32_768)  # vectors and queries of a block, at least and at most
BLOCKS = 4  # that a corpus makes, until its blocks are the largest; as often is a query sent
SCORES = 4_000_000  # of a block that are held at a time
ASK_ROWS = 32_768  # queries times packs in a batch of asks
MARGIN = 2e-6  # of a similarity: results are ranked on six digits
NO_CELL = -1  # vectors without length; asked by all


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _packed(units: np.ndarray) -> pa.Array:
    return pa.array([u.tobytes() for u in units], pa.binary())


def fit_centroids(vectors: DataFrame, dim: int, count: int, sample: int = SAMPLE, cells: int = CELLS) -> np.ndarray:
    """Unit centroids of about the square root of ``count`` cells, from vectors whose hash lies below a bound; what the driver sees."""
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * sample // max(1, count))
    rows = vectors.where(F.xxhash64("vector") <= F.lit(bound)).select("vector").distinct().collect()
    units = _unit(np.array([r.vector for r in rows], np.float64).reshape(len(rows), dim))
    units = units[np.lexsort(units.T)]
    units = units[np.linalg.norm(units, axis=1) > 0]
    wanted = min(cells, max(1, int(count ** 0.5)), len(units))
    if not wanted:
        return np.zeros((0, dim))
    centres = units[np.random.default_rng(0).choice(len(units), wanted, replace=False)]
    for _ in range(8):
        near = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def _celled(corpus: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """doc_id, grp, cell, angle to its centroid, unit (bytes) of every vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column("vector"), dim))
            long = np.linalg.norm(units, axis=1) > 0
            cell, angle = np.full(len(units), NO_CELL, np.int32), np.zeros(len(units))
            if long.any():
                near = units[long] @ centres.T
                cell[long], angle[long] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grp"), pa.array(cell), pa.array(angle), _packed(units)],
                                             names=["doc_id", "grp", "cell", "angle", "unit"])

    return corpus.mapInArrow(place, "doc_id long, grp string, cell int, angle double, unit binary")


def _choose(queries: DataFrame, centres: np.ndarray, probes: int, reach: float | None = None, rows: int = ASK_ROWS) -> DataFrame:
    """row, query_id, grp, floor, pack: the packs of the ``probes`` nearest of a query's cells; or, with ``reach``, all others its ``floor`` leaves open.

    ``queries`` carries the cells of its group as ``cells`` (cell, radius, pack). No batch has more than ``rows`` rows, or one query's."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asks(batch: pa.RecordBatch, who: list[int], packs: list[np.ndarray]) -> pa.RecordBatch:
            at = pa.array(np.repeat(np.array(who, np.int64), [len(p) for p in packs]))
            return pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in ("row", "query_id", "grp", "floor")), pa.array(np.concatenate(packs).astype(np.int32))],
                                              names=["row", "query_id", "grp", "floor", "pack"])

        for batch in batches:
            who, packs, held = [], [], 0
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            for i, (data, cells) in enumerate(zip(batch.column("unit"), batch.column("cells"))):
                unit, its = np.frombuffer(data.as_py(), np.float64), cells.values
                cell, radius, pack = (its.field(n).to_numpy(zero_copy_only=False) for n in ("cell", "radius", "pack"))
                away = np.where(cell == NO_CELL, -1.0, np.arccos(np.clip(centres[cell] @ unit, -1, 1)) if len(centres) else 0.0)
                order = np.argsort(away, kind="stable")
                first = probes + int((cell == NO_CELL).any())
                if reach is None:
                    take = np.unique(pack[order[:first]])
                else:
                    take = order[first:]
                    if floors[i] > -2 and unit.any():
                        take = take[np.cos(np.maximum(0, away[take] - reach * radius[take])) >= floors[i] - MARGIN]
                    take = np.setdiff1d(pack[take], pack[order[:first]])
                if held and held + len(take) > rows:
                    yield asks(batch, who, packs)
                    who, packs, held = [], [], 0
                who.append(i)
                packs.append(take)
                held += len(take)
            if held:
                yield asks(batch, who, packs)

    return queries.mapInArrow(choose, "row long, query_id long, grp string, floor double, pack int")


def _meet(asked: DataFrame, units: DataFrame, docs: DataFrame, dim: int, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """query_id, doc_id, similarity: the best ``k`` documents of every block of a pack for the queries that ask it, if they reach the query's floor.

    ``asked`` names the rows of ``units``, which join last: a vector is shuffled once for a pack and stored for none."""
    pack = ["grp", "pack"]
    asks = asked.groupBy(*pack).agg(F.ceil(F.count("*") / block_rows).alias("ask_blocks"))
    holds = docs.groupBy(*pack).agg(F.ceil(F.count("*") / block_rows).alias("held_blocks"))
    sizes = cut_lineage(asks.join(holds, pack))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, pack).select(*pack, "row", "query_id", "floor", F.pmod(F.xxhash64("query_id"), "ask_blocks").alias("ask"), every("held_blocks").alias("held"))
    left = left.join(by_shuffle(units.select("row", "unit")), "row").drop("row")
    right = docs.join(sizes, pack).select(*pack, "doc_id", "unit", F.pmod(F.xxhash64("doc_id"), "held_blocks").alias("held"), every("ask_blocks").alias("ask"))

    def best(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": [], "doc_id": [], "similarity": []})
        held = held.sort_values("doc_id", kind="stable")
        a, b = (np.frombuffer(b"".join(x.unit), np.float64).reshape(len(x), dim) for x in (queries, held))
        ids, asking = held.doc_id.to_numpy(), queries.query_id.to_numpy()
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, floors, parts = ids[first], queries.floor.to_numpy(), []
        step = max(1, SCORES // len(b))
        for low in range(0, len(a), step):
            mine, floor = asking[low:low + step], floors[low:low + step]
            scores = np.round(np.maximum.reduceat(a[low:low + step] @ b.T, first, axis=1), 6)
            scores[scores < floor[:, None]] = -np.inf
            if exclude_self:
                scores[mine[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:  # ties at the limit are kept and settled by id
                limit = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                q, d = np.nonzero((scores >= limit[:, None]) & np.isfinite(scores))
            else:
                q, d = np.nonzero(np.isfinite(scores))
            order = np.lexsort((ids[d], -scores[q, d], q))
            q, d = q[order], d[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, d = q[place < k], d[place < k]
            parts.append(pd.DataFrame({"query_id": mine[q], "doc_id": ids[d], "similarity": scores[q, d]}))
        return pd.concat(parts)

    keys = [*pack, "ask", "held"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, doc_id long, similarity double")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, group: str | None = None, exclude_self: bool = False, reach: float = 1.0,
            probes: int = PROBES, sample: int = SAMPLE, block_rows: int | None = None) -> DataFrame:
    """``(query_id, doc_id, similarity, rank)``: the ``k`` documents of highest cosine per query.

    ``corpus`` has doc_id, vector (several rows per document allowed, the best one counts), ``queries`` has query_id,
    vector. Vectors meet those of their own dimension; null and empty ones meet nothing, those without length have
    similarity 0 to all. With ``group`` both sides carry that column and only equal groups (nulls among them) match.

    ``reach`` is the share of a cell's radius that is taken off its angle: 1 gives the true neighbours, less leaves out
    cells that could only hold a few; with 0 no cell is asked whose centroid is farther than the k-th best.

    Without ``block_rows`` a block holds a quarter of the corpus within ``BLOCK_ROWS``: what is shuffled is blocks met
    with blocks, so their number has to stay.
    """
    grp = (F.coalesce(F.col(group).cast("string"), F.lit("\0")) if group else F.lit("")).alias("grp")
    vector = F.col("vector").cast("array<double>").alias("vector")
    parts = []
    for r in queries.where("size(vector) > 0").select(F.size("vector").alias("dim")).distinct().collect():
        dim = r.dim
        # read three times below; a corpus is often the end of a long filter
        held = cut_lineage(corpus.where(F.size("vector") == dim).select(F.col("doc_id").cast("long").alias("doc_id"), grp, "vector")).withColumn("vector", vector)
        asked = queries.where(F.size("vector") == dim).select(F.col("query_id").cast("long").alias("query_id"), grp, vector)
        count = held.count()
        size = block_rows or min(max(BLOCK_ROWS[0], -(-count // BLOCKS)), BLOCK_ROWS[1])
        centres = fit_centroids(held, dim, count, sample)
        docs = cut_lineage(_celled(held, centres, dim))
        cells = docs.groupBy("grp", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        # cells are packed to about a block, so that a query is sent once for all it asks of a pack; at most CELLS + 1 of a group
        before = F.sum("n").over(Window.partitionBy("grp").orderBy("cell")) - F.col("n")
        cells = cut_lineage(cells.select("grp", "cell", "radius", F.floor(before / size).cast("int").alias("pack")))
        docs = cut_lineage(docs.join(cells.select("grp", "cell", "pack"), ["grp", "cell"]).select("grp", "pack", "doc_id", "unit"))
        cells = cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cell", "radius", "pack"))).alias("cells"))
        units = asked.mapInArrow(lambda batches, dim=dim: (
            pa.RecordBatch.from_arrays([b.column("query_id"), b.column("grp"), _packed(_unit(_matrix(b.column("vector"), dim)))], names=["query_id", "grp", "unit"]) for b in batches),
            "query_id long, grp string, unit binary")
        # a query may have several vectors: rows are numbered before they are written
        units = cut_lineage(units.withColumn("row", F.monotonically_increasing_id()))
        found = _meet(cut_lineage(_choose(units.withColumn("floor", F.lit(-9.0)).join(cells, "grp"), centres, probes)), units, docs, dim, k, exclude_self, size)
        found = cut_lineage(found)
        once = found.groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
        top = top_per_group(once, ["query_id"], [F.col("similarity").desc(), F.col("doc_id")], k)
        floor = top.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("floor"))
        # the list of cells is longer than a vector: it comes last and is not shuffled with the queries
        open_ = units.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-9.0))).join(cells, "grp")
        found = found.unionByName(_meet(cut_lineage(_choose(open_, centres, probes, reach)), units, docs, dim, k, exclude_self, size))
        parts.append(found)
    if not parts:
        parts = [queries.sparkSession.createDataFrame([], "query_id long, doc_id long, similarity double")]
    best = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    return top_per_group(best, ["query_id"], [F.col("similarity").desc(), F.col("doc_id")], k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row n_exact, n_found, recall: how many of the exact neighbours, or others as near as the last of them, were found."""
    last = exact.groupBy("query_id").agg(F.min("similarity").alias("last"), F.count("*").alias("n"))
    hits = approximate.join(last.select("query_id", "last"), "query_id").where("similarity >= last").groupBy("query_id").agg(F.count("*").alias("hits"))
    both = last.join(hits, "query_id", "left").select("n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_exact"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_found"), F.try_divide(F.sum("hits"), F.sum("n")).alias("recall"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, model: str | None = None,
                  live: DataFrame | None = None, reach: float = 1.0) -> DataFrame:
    """Best vector of any kind per article; only the active model and live articles take part."""
    corpus = vectors if model is None else vectors.where(F.col("model") == model)
    if live is not None:
        corpus = corpus.join(live.select("article_id"), "article_id", "left_semi")
    corpus = corpus.select(F.col("article_id").alias("doc_id"), "vector")
    return nearest(corpus, queries, k, reach=reach)


def similar(vectors: DataFrame, articles: DataFrame, article_topics: DataFrame, k: int = 10,
            targets: DataFrame | None = None, fetch: int = 3, kind: str | None = None, model: str | None = None,
            reach: float = 1.0) -> DataFrame:
    """``(article_id, similar_id, score, rank)``: ``1 / (1 + distance) + 0.3 * shared-topic score``.

    Only vectors of ``kind`` and ``model`` take part, if given. The ``fetch * k`` nearest live articles of the same language are candidates. A shared topic counts with
    the candidate's best score; topics meet through the candidate pairs, never article by article.
    """
    lang = articles.select(F.col("article_id").alias("doc_id"), "lang", F.col("dedupe_of").isNull().alias("live"))
    if kind is not None:
        vectors = vectors.where(F.col("kind") == kind)
    if model is not None:
        vectors = vectors.where(F.col("model") == model)
    side = vectors.select(F.col("article_id").alias("doc_id"), "vector").join(lang, "doc_id")
    asked = side if targets is None else side.join(targets.select(F.col("article_id").alias("doc_id")), "doc_id", "left_semi")
    # read twice below
    found = cut_lineage(nearest(side.where("live").drop("live"), asked.select(F.col("doc_id").alias("query_id"), "vector", "lang"),
                                k * fetch, group="lang", exclude_self=True, reach=reach))
    mine = article_topics.select(F.col("article_id").alias("query_id"), "topic_id")
    theirs = article_topics.select(F.col("article_id").alias("doc_id"), "topic_id", "score")
    shared = (
        found.select("query_id", "doc_id").join(mine, "query_id").join(theirs, ["doc_id", "topic_id"])
        .groupBy("query_id", "doc_id").agg(F.max("score").alias("topic_score"))
    )
    scored = found.drop("rank").join(shared, ["query_id", "doc_id"], "left").select(
        F.col("query_id").alias("article_id"), F.col("doc_id").alias("similar_id"),
        F.round(1.0 / (2.0 - F.col("similarity")) + 0.3 * F.coalesce("topic_score", F.lit(0.0)), 6).alias("score"))
    return top_per_group(scored, ["article_id"], [F.col("score").desc(), F.col("similar_id")], k)
