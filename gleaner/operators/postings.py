"""A stored keyword index: posting lists by bucket of their term, read for the asked terms only.

A task cuts its documents into segments of bounded size and turns each into one list per term, so neither
texts nor lists are shuffled: a task sorts its lists by bucket and writes its own file of each. A list carries its documents, counts, lengths and positions and,
for its segment, the largest count and the smallest length, which bound every score in it. The positions of all its
documents stand one after the other, without an array of their own, which would be several times their size; ``ends``
says where those of each document end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokens

SEGMENT_TOKENS = 2_000_000
BUCKETS = 256
LIST = ("segment long, term string, n int, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>, ends array<int>, places array<int>")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lists(segment: int, ids: list[np.ndarray], words: list[pa.Array], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of one segment: a null term with all its documents in order, then a row per term."""
    doc, size = np.concatenate(ids), np.concatenate(lengths)
    order = np.argsort(doc, kind="stable")
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    doc, dl = doc[order], size[order].astype(np.int32)
    ints = lambda a: pa.array(a.astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([segment]), pa.array([None], pa.string()), ints(np.array([len(doc)])), ints(np.array([0])), ints(np.array([0])), listed(pa.array(doc)),
               listed(ints(np.zeros(len(doc)))), listed(ints(dl)), *(pa.array([None], pa.list_(pa.int32())) for _ in range(2))]
    names = ["segment", "term", "n", "max_tf", "min_dl", "docs", "tfs", "dls", "ends", "places"]
    yield pa.RecordBatch.from_arrays(columns, names=names)
    if not size.sum():
        return
    coded = pa.chunked_array(words).unify_dictionaries().combine_chunks()
    code, owner = coded.indices.to_numpy().astype(np.int64), np.repeat(place, size)
    at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    pair = code * len(doc) + owner
    by_pair = np.argsort(pair, kind="stable")  # positions stay in order
    pair, at = pair[by_pair], at[by_pair]
    begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    term, member = np.divmod(pair[begin], len(doc))
    tf = np.diff(np.r_[begin, len(pair)])
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    cuts, sizes = np.r_[first, len(term)].astype(np.int32), dl[member]
    spans = np.r_[begin, len(pair)]
    ends = spans[1:] - np.repeat(spans[first], np.diff(cuts))
    places = pa.ListArray.from_arrays(ints(spans[cuts]), ints(at))
    columns = [pa.array(np.full(len(first), segment)), coded.dictionary.take(pa.array(term[first])), ints(np.diff(cuts)), ints(np.maximum.reduceat(tf, first)),
               ints(np.minimum.reduceat(sizes, first)), *(pa.ListArray.from_arrays(ints(cuts), v) for v in (pa.array(doc[member]), ints(tf), ints(sizes), ints(ends))), places]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    for low in range(0, len(batch), 4_096):
        yield batch.slice(low, 4_096)


def write_index(df: DataFrame, doc_id: str, text: Column, path: str, buckets: int = BUCKETS, segment_tokens: int = SEGMENT_TOKENS, segments_from: int = 0) -> None:
    """Writes lists and documents of ``df`` (one row per ``doc_id``) below ``path``; null texts have no terms.

    Several writes may share an index, each in a ``batch=`` folder with numbers of its own from ``segments_from``.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        ids, words, lengths = [], [], []
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                lists = part.column("toks")
                ids.append(part.column("doc_id").to_numpy())
                lengths.append(pc.list_value_length(lists).to_numpy())
                words.append(pc.list_flatten(lists).dictionary_encode())
                held += int(lengths[-1].sum())
                if held >= segment_tokens:
                    yield from _lists(segments_from + (task << 32 | number), ids, words, lengths)
                    number, held, ids, words, lengths = number + 1, 0, [], [], []
        if ids:
            yield from _lists(segments_from + (task << 32 | number), ids, words, lengths)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), tokens(text).alias("toks"))
    rows = rows.mapInArrow(build, LIST).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), buckets)))
    # lists take up more than the texts and stay in the task that built them: it writes a file to each bucket's folder
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class PostingIndex:
    """A written index; ``lists`` prunes to the buckets it is asked for."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _read(self) -> DataFrame:
        names = [f.split()[0] for f in LIST.split(", ")]
        return self.spark.read.schema(LIST + ", bucket int").parquet(self.path).select(*names, "bucket")

    def docs(self) -> DataFrame:
        """segment, docs, dls: the documents of every segment in order."""
        return self._read().where("bucket = -1").select("segment", "docs", "dls")

    def lists(self, terms: DataFrame) -> DataFrame:
        """Posting lists of ``terms`` (term, distinct); only their buckets are read."""
        asked = [r.b for r in terms.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # at most one per bucket
        return self._read().where(F.col("bucket").isin(asked)).join(terms, "term", "left_semi").drop("bucket")
