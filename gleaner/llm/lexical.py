"""Ranked lexical search over posting lists with range-maximum sparse tables.

``write_index`` cuts the corpus into segments of bounded size, without a shuffle, and writes one posting list per
segment and term, sorted by term. ``search`` takes the items in blocks of bounded size; a block reads the posting lists
of its own terms, and a task holds those of one segment. There every list gets a sparse table of range maxima of its
impacts. An item's search keeps intervals of documents, each bounded by the sum of the lists' maxima in it, splits the
best of them at the document of the largest single impact, scores that document, and ends once no interval can still
give one of the best k. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stored, text_or_empty, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT_TERMS = 2_000_000  # places of terms in a segment
BLOCK_TERMS = 200_000  # terms of the items that are asked together
NULL_ID = (1 << 63) - 1  # stands for a null doc_id, behind all others
INDEX = "segment long, term string, n long, total long, places binary, counts binary, ids binary"


class Segment:
    """Documents of one task until they are written as posting lists."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.words: list[pa.Array] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        word = pc.not_equal(flat, "")
        flat, parent = flat.filter(word), parent.filter(word).to_numpy()
        self.words.append(flat.dictionary_encode())
        self.lengths.append(np.bincount(parent, minlength=len(texts)))
        self.ids.append(pc.fill_null(ids, NULL_ID).to_numpy())
        self.size += len(flat)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row of all documents with a term (ids, lengths), then one row per term in order."""
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        order = np.lexsort((np.arange(len(ids)), ids))
        order = order[lengths[order] > 0]
        place = np.full(len(ids), -1, np.int64)
        place[order] = np.arange(len(order))
        yield _rows([self.number], [None], [len(order)], [int(lengths.sum())], [b""], [lengths[order].astype("<i4").tobytes()], [ids[order].astype("<i8").tobytes()])
        if not self.size:
            return
        words = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        by_name = pc.sort_indices(words.dictionary)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        docs = len(order)
        pairs, counts = np.unique(rank[words.indices.to_numpy()] * docs + np.repeat(place, lengths), return_counts=True)
        term, at = np.divmod(pairs, docs)
        first = np.searchsorted(term, np.arange(len(by_name) + 1))
        steps = np.diff(at, prepend=0)
        steps[first[:-1]] = at[first[:-1]]
        names = words.dictionary.take(by_name)
        for low in range(0, len(names), 1 << 15):
            high = min(len(names), low + (1 << 15))
            a, b = first[low], first[high]
            cuts = pa.py_buffer(((first[low:high + 1] - a) * 4).astype(np.int32))
            lists = [pa.Array.from_buffers(pa.binary(), high - low, [None, cuts, pa.py_buffer(x[a:b].astype("<i4"))]) for x in (steps, counts)]
            size = high - low
            yield _rows(np.full(size, self.number), names[low:high], np.diff(first[low:high + 1]), pa.nulls(size, pa.int64()), *lists, pa.nulls(size, pa.binary()))


def _rows(segment, term, n, total, places, counts, ids) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((segment, term, n, total, places, counts, ids), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "total", "places", "counts", "ids"])


def write_index(docs: DataFrame, path: str, segment_terms: int = SEGMENT_TERMS) -> None:
    """Writes the posting lists of whole texts of ``docs`` (doc_id, text; other columns are not read) to ``path``.

    Null and empty texts have no terms; repeated rows are documents of their own.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        segment = Segment(task << 32)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            low, held, sizes = 0, 0, pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            for at, size in enumerate(sizes):
                held += int(size)
                if held > 1 << 22 or at + 1 == len(sizes):
                    segment.add(ids[low:at + 1], texts[low:at + 1])
                    low, held = at + 1, 0
                    if segment.size >= segment_terms:
                        yield from segment.rows()
                        number += 1
                        segment = Segment(task << 32 | number)
        if segment.ids:
            yield from segment.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(build, INDEX).write.option("compression", "zstd").parquet(path)


class Lists:
    """Posting lists of a segment, end to end, and the range-maximum table over their impacts."""

    def __init__(self, docs: int, places: list[np.ndarray], impacts: list[np.ndarray]):
        self.docs = docs
        self.ends = np.cumsum([len(p) for p in places])
        self.starts = self.ends - [len(p) for p in places]
        self.place, self.impact = np.concatenate(places), np.concatenate(impacts)
        self.key = np.repeat(np.arange(len(places), dtype=np.int64), self.ends - self.starts) * docs + self.place
        n, longest = len(self.key), int((self.ends - self.starts).max())
        table = [np.arange(n, dtype=np.int32)]
        while (half := 1 << len(table) - 1) * 2 <= longest:
            low = table[-1]
            high = np.concatenate((low[half:], low[n - half:]))  # the last ones are never asked
            table.append(np.where(self.impact[low] >= self.impact[high], low, high))
        self.table = np.stack(table)
        self.level = np.zeros(longest + 1, np.int64)
        for k in range(1, len(table)):
            self.level[1 << k:] = k

    def rate(self, low: np.ndarray, high: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of list ranges: the sum of their maxima, and the document of the largest."""
        size = high - low
        level = self.level[size]
        a = self.table[level, np.minimum(low, len(self.key) - 1)]
        b = self.table[level, high - (1 << level)]
        x, y = self.impact[a], self.impact[b]
        value = np.maximum(x, y) * times * (size > 0)
        top = value.argmax(axis=1)
        row = np.arange(len(top))
        return value.sum(axis=1), self.place[np.where(x[row, top] >= y[row, top], a[row, top], b[row, top])]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for a query of ``terms`` with ``times``; only scores above 0."""
        none = np.zeros(0, np.int64)
        low, high = self.starts[None, terms], self.ends[None, terms]
        first, (bound, split) = np.zeros(1, np.int64), self.rate(low, high, times)
        found, score, step = none, none, 8
        while True:
            full = len(found) >= k
            least, last = (score[-1], found[-1]) if full else (0, -1)
            live = np.flatnonzero((bound > least) | (bound == least) & (first < last))
            if not len(live):
                return found, score
            take = live if len(live) <= step else live[np.argpartition(bound[live], len(live) - step)[-step:]]
            doc = split[take]
            sought = terms * self.docs + doc[:, None]
            at = np.searchsorted(self.key, sought)
            there = np.minimum(at, len(self.key) - 1)
            hit = self.key[there] == sought
            found, score = np.concatenate((found, doc)), np.concatenate((score, (self.impact[there] * hit * times).sum(axis=1)))
            order = np.lexsort((found, -score))[:k]
            found, score = found[order], score[order]
            new = np.concatenate((low[take], at + hit)), np.concatenate((at, high[take])), np.concatenate((first[take], doc + 1))
            worth, cut = self.rate(new[0], new[1], times)
            least = score[-1] if len(score) >= k else 0
            fit = (worth >= least) & (worth > 0)
            stay = np.setdiff1d(live, take, assume_unique=True)
            low, high = np.concatenate((low[stay], new[0][fit])), np.concatenate((high[stay], new[1][fit]))
            first, bound, split = (np.concatenate((old[stay], x[fit])) for old, x in ((first, new[2]), (bound, worth), (split, cut)))
            step = min(256, step * 2)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of the index at ``path`` for every row of ``items`` (item_id, text).

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), its repeats in an item count again; scores of 0 are left out.
    Items without terms or without a match give no row; repeated rows of items are one item, and rows of one item_id with
    different texts are ranked each by itself. A null doc_id is returned as null, behind equal scores.
    """
    index = spark.read.schema(INDEX).parquet(path)
    docs, lists = index.where("term IS NULL"), index.where("term IS NOT NULL")
    stats = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n_docs, n_terms = int(stats[0]), int(stats[1])
    asked = items.select("item_id", text_or_empty().alias("text")).distinct()
    asked = asked.select(F.xxhash64("item_id", "text").alias("query"), "item_id", F.explode(words_of(F.col("text"))).alias("term"))
    asked = stored(asked.groupBy("query", "item_id", "term").agg(F.count("*").alias("times")), "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod("query", F.lit(blocks)))
    parts: DataFrame | None = None
    for block in range(blocks if n_terms else 0):  # one at a time: the driver holds the terms of one block only
        part = stored(_block(asked.where(F.col("block") == block), docs, lists, n_docs, n_terms, k), "ranked")
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        parts = spark.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


def _block(asked: DataFrame, docs: DataFrame, lists: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, doc_id, score: the ``k`` best of every segment for a block of items."""
    terms = asked.select("term").distinct()
    wanted = lists.join(F.broadcast(terms), "term", "left_semi")  # at most a block's terms
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("n") + 1))).cast("long")
    weights = {r.term: r.weight for r in wanted.groupBy("term").agg(weight.alias("weight")).collect()}
    queries: dict[int, list[tuple[str, int]]] = {}
    for r in asked.where(F.col("term").isNotNull()).select("query", "term", "times").collect():
        if weights.get(r.term, 0) > 0:
            queries.setdefault(r["query"], []).append((r.term, r.times))

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        here = rows.term.isna()
        head, rows = rows[here].iloc[0], rows[~here]
        ids, length = np.frombuffer(head.ids, "<i8"), np.frombuffer(head.counts, "<i4").astype(np.int64)
        norm = 100 - 25 + (25 * length * n_docs) // n_terms
        names, places, impacts = {}, [], []
        for term, steps, counts in zip(rows.term, rows.places, rows.counts):
            weight = weights.get(term, 0)
            if weight > 0:
                at, tf = np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64), np.frombuffer(counts, "<i4").astype(np.int64)
                names[term] = len(names)
                places.append(at)
                impacts.append(weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[at])))
        out: list[pd.DataFrame] = []
        if names:
            index = Lists(len(ids), places, impacts)
            for query, its in queries.items():
                known = [(names[t], n) for t, n in its if t in names]
                if known:
                    found, score = index.best(*(np.array(x, np.int64) for x in zip(*known)), k)
                    out.append(pd.DataFrame({"query": query, "doc_id": pd.array(ids[found], "Int64"), "score": score}))
        if not out:
            return pd.DataFrame({"query": [], "doc_id": [], "score": []})
        out = pd.concat(out)
        out.loc[out.doc_id == NULL_ID, "doc_id"] = pd.NA
        return out

    return wanted.unionByName(docs).groupBy("segment").applyInPandas(find, "query long, doc_id long, score long")
