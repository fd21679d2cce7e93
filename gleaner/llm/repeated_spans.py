"""Repeated byte strings by bucket-pointer refinement on sampled suffixes.

The suffixes that take part begin at anchors: of the q-grams in every window of ``length`` bytes the one with the least
hash. Equal windows pick the same anchor at the same place, so no repeat is missed. Bucket identifiers are built by
doubling, those of 2k bytes from those of k bytes here and k bytes later, each level reused by the next. Anchors start
in buckets by their q-gram; a bucket of one is done. A bucket is refined by the identifiers of all the bytes that its
anchors' windows reach: anchors that stay together have only repeated windows. What is alone after that stands at an
edge of a repeat, and its windows are compared one by one, again by identifiers of later offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_or_empty

LENGTH, GRAM = 200, 96  # bytes; windows reach 304 bytes at most, which three identifiers of 128 bytes cover
PICK = LENGTH - GRAM + 1  # q-grams of a window
HOT = 256  # anchors of one bucket in a task, from which on the bucket's windows are dealt out one by one
MARK, ASK, ASK_HOT = 0, 1, 2
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * A
    h += b
    h ^= h >> np.uint64(32)
    h *= B
    h ^= h >> np.uint64(29)
    return h


class Identifiers:
    """Bucket identifiers of the 8, 16, 32, 64 and 128 bytes from each position; beyond the data's end they see zeros."""

    def __init__(self, data: bytes):
        self.n = len(data)
        padded = data + bytes(136)
        level = _join(np.ndarray(self.n + 128, "<u8", padded, strides=(1,)), np.uint64(8))
        self.by = {8: level[:self.n]}
        size = 8
        while size < 128:
            level = _join(level[:-size], level[size:])
            size *= 2
            self.by[size] = level[:self.n]

    def at(self, places: np.ndarray, *sizes: int) -> np.ndarray:
        """Identifier of the bytes from ``places`` on, as many as the sizes make together."""
        out, after = self.by[sizes[0]][places], sizes[0]
        for size in sizes[1:]:
            out, after = _join(out, self.by[size][places + after]), after + size
        return out

    def windows(self, places: np.ndarray) -> np.ndarray:
        return self.at(places, 128, 64, 8)


def anchors(ids: Identifiers, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (first, last) with their anchor, in data made of texts that end at ``ends``."""
    n = ids.n
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    grams = _join(ids.by[64][:n - GRAM + 1], ids.by[32][64:64 + n - GRAM + 1])
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(key) // PICK)
    grid = np.full(blocks * PICK, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(key)] = key
    grid = grid.reshape(blocks, PICK)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    pick = (np.minimum(behind[:count], ahead[PICK - 1:PICK - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(count, bool)
    for start, end in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
        valid[start:max(start, end - LENGTH + 1)] = True
    change = np.concatenate(([True], (pick[1:] != pick[:-1]) | (valid[1:] != valid[:-1])))
    first = np.flatnonzero(change)
    last = np.append(first[1:], count) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last, pick[first]


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and the compressed UTF-8 bytes of every row; row numbers are fixed by writing them."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [pack(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["row", "doc_id", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(squeeze, "row long, doc_id long, packed binary"), "bytes")


def unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(packed)


def batches_of(values: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= size or i + 1 == len(values):
            yield start, i + 1
            start, total = i + 1, 0


ENTRY = np.dtype([("gram", "<u4"), ("whole", "<u8"), ("row", "<i8"), ("first", "<u4"), ("n", "u1"), ("flag", "u1")])
MANY, SIGNAL = 1, 2  # flags: met more than once in the task; only tells that the bucket is hot
BLOBS = "part long, blob binary"
FOUND = np.dtype([("row", "<i8"), ("first", "<i8"), ("n", "<i8"), ("kind", "<i8"), ("bucket", "<i8")])


def _found(entries: np.ndarray, kind, part) -> np.ndarray:
    out = np.zeros(len(entries), FOUND)
    out["row"], out["first"], out["n"], out["kind"] = entries["row"], entries["first"], entries["n"], kind
    out["bucket"] = entries["gram"].astype(np.int64) | np.asarray(part, np.int64) << 32
    return out


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of each element, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _blob(part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["part", "blob"])


def first_buckets(texts: DataFrame, parts: int, hot_from: int = HOT) -> DataFrame:
    """row, first, n, kind, bucket: runs of windows that are repeated (MARK) or to be compared (ASK, ASK_HOT)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_parts, all_entries = [], []
        for batch in batches:
            rows, data = batch.column("row").to_numpy(), [unpacked(p) for p in batch.column("packed").to_pylist()]
            for a, b in batches_of(data):
                ends = np.cumsum([len(d) for d in data[a:b]])
                ids = Identifiers(b"".join(data[a:b]))
                first, last, anchor = anchors(ids, ends)
                if not len(first):
                    continue
                gram, reach = ids.at(anchor, 64, 32), last - first + LENGTH
                whole = _join(_join(_join(ids.by[128][first], ids.by[128][first + (reach - 128) // 2]), ids.by[128][first + reach - 128]),
                              (reach * 1024 + anchor - first).astype(np.uint64))
                doc = np.searchsorted(ends, first, "right")
                e = np.zeros(len(first), ENTRY)
                e["gram"], e["whole"], e["row"] = (gram >> np.uint64(32)).astype(np.uint32), whole, rows[a + doc]
                e["first"], e["n"] = first - np.concatenate(([0], ends[:-1]))[doc], last - first + 1
                all_parts.append((gram % np.uint64(parts)).astype(np.int32))
                all_entries.append(e)
        if not all_entries:
            return
        part, e = np.concatenate(all_parts), np.concatenate(all_entries)
        order = np.lexsort((e["whole"], e["gram"], part))
        part, e = part[order], e[order]
        group = _groups(part, e["gram"], e["whole"])
        size = np.bincount(group)[group]
        # equal reaches in this task are repeated; one of them goes on for all
        local = [_found(e[size > 1], MARK, part[size > 1])]
        one = np.concatenate(([True], group[1:] != group[:-1]))
        e["flag"] = np.where(size > 1, MANY, 0)
        part, e = part[one], e[one]
        bucket = _groups(part, e["gram"])
        hot = np.bincount(bucket)[bucket] > hot_from
        local.append(_found(e[hot], ASK_HOT, part[hot]))
        signal = hot & np.concatenate(([True], bucket[1:] != bucket[:-1]))
        e["flag"][signal] = SIGNAL
        sent = ~hot | signal
        part, e = part[sent], e[sent]
        yield _blob(-1 - TaskContext.get().partitionId(), np.concatenate(local).tobytes())
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            if cuts[p + 1] > cuts[p]:
                yield _blob(p, e[cuts[p]:cuts[p + 1]].tobytes())

    def refine(rows: pd.DataFrame) -> pd.DataFrame:
        part, data = int(rows.part.iloc[0]), b"".join(rows.blob)
        if part < 0:
            return pd.DataFrame(np.frombuffer(data, FOUND))
        e = np.frombuffer(data, ENTRY)
        e = e[np.lexsort((e["whole"], e["gram"]))]
        bucket = _groups(e["gram"])
        hot = (np.bincount(bucket, e["flag"] == SIGNAL) > 0)[bucket]
        real = e["flag"] != SIGNAL
        total = np.bincount(bucket, np.where(e["flag"] == MANY, 2, 1))[bucket] + hot  # a hot bucket has others
        e, bucket, hot = e[real & (total > 1)], bucket[real & (total > 1)], hot[real & (total > 1)]
        group = _groups(bucket, e["whole"])
        together = np.bincount(group, np.where(e["flag"] == MANY, 2, 1))[group] > 1
        lead = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else group.astype(bool)
        leads = np.bincount(bucket, lead)[bucket] if len(bucket) else bucket
        asked = lead & ((leads > 1) | hot)
        return pd.DataFrame(np.concatenate((_found(e[together], MARK, part), _found(e[asked], np.where(hot[asked], ASK_HOT, ASK), part))))

    return texts.select("row", "packed").mapInArrow(entries, BLOBS).groupBy("part").applyInPandas(refine, "row long, first long, n long, kind long, bucket long")


def compared(texts: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """row, first, n: the runs of repeated windows among those ``asked``.

    What a bucket's windows reach meets in one task; the windows of hot buckets are dealt out by their identifiers.
    """
    reach, window = np.dtype([("row", "<i8"), ("first", "<i8"), ("n", "<i8")]), np.dtype([("id", "<u8"), ("row", "<i8"), ("first", "<u4")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reaches: dict[int, list[bytes]] = {}
        windows, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for p, pieces in reaches.items():
                yield _blob(p, b"".join(pieces))
            reaches.clear()
            if windows:
                w = np.concatenate(windows)
                p = (w["id"] % np.uint64(parts)).astype(np.int32)
                order = np.argsort(p, kind="stable")
                w, cuts = w[order], np.searchsorted(p[order], np.arange(parts + 1))
                for k in range(parts):
                    if cuts[k + 1] > cuts[k]:
                        yield _blob(-1 - k, w[cuts[k]:cuts[k + 1]].tobytes())
                windows.clear()

        for batch in batches:
            for row, packed, runs in zip(batch.column("row").to_pylist(), batch.column("packed").to_pylist(), batch.column("runs").to_pylist()):
                data, ids = unpacked(packed), None
                for run in runs:
                    first, n = run["first"], run["n"]
                    if run["kind"] == ASK:
                        part = run["bucket"] >> 32
                        head = np.array([(row, first, n)], reach).tobytes()
                        reaches.setdefault(part, []).append(head + data[first:first + n + LENGTH - 1])
                        held += n + LENGTH + 24
                    else:
                        ids = ids or Identifiers(data)
                        w = np.zeros(n, window)
                        w["first"] = np.arange(first, first + n)
                        w["id"], w["row"] = ids.windows(w["first"].astype(np.int64)), row
                        windows.append(w)
                        held += 20 * n
                if held > 1 << 25:
                    yield from flush()
                    held = 0
        yield from flush()

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        part, data = int(rows.part.iloc[0]), b"".join(rows.blob)
        if part < 0:
            w = np.frombuffer(data, window)
            id_, row, first = w["id"], w["row"], w["first"].astype(np.int64)
        else:
            heads, starts, at = [], [], 0
            while at < len(data):
                head = np.frombuffer(data, reach, 1, at)[0]
                heads.append(head)
                starts.append(at + reach.itemsize)
                at += reach.itemsize + int(head["n"]) + LENGTH - 1
            h, starts = np.array(heads, reach), np.array(starts)
            ids, run = Identifiers(data), np.repeat(np.arange(len(h)), h["n"])
            offset = np.arange(len(run)) - np.repeat(np.cumsum(h["n"]) - h["n"], h["n"])
            places = starts[run] + offset
            id_, row, first = ids.windows(places), h["row"][run], h["first"][run] + offset
        order = np.argsort(id_, kind="stable")
        group = _groups(id_[order])
        hit = np.zeros(len(id_), bool)
        if len(group):
            hit[order] = np.bincount(group)[group] > 1
        row, first = row[hit], first[hit]
        order = np.lexsort((first, row))
        row, first = row[order], first[order]
        if not len(row):
            return pd.DataFrame({"row": [], "first": [], "n": []}).astype("int64")
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)))
        at = np.flatnonzero(new)
        return pd.DataFrame({"row": row[at], "first": first[at], "n": np.diff(np.append(at, len(row)))})

    runs = asked.groupBy("row").agg(F.collect_list(F.struct("first", "n", "kind", "bucket")).alias("runs"))
    return texts.join(runs, "row").select("row", "packed", "runs").mapInArrow(send, BLOBS).groupBy("part").applyInPandas(repeated, "row long, first long, n long")


def repeated_windows(docs: DataFrame, hot_from: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The numbered texts, and runs (row, first, n) of window starts whose ``LENGTH`` bytes also start elsewhere."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = numbered(docs)
    found = stored(first_buckets(texts, parts, hot_from), "buckets")
    edges = compared(texts, found.where(F.col("kind") != MARK), parts)
    return texts, found.where(F.col("kind") == MARK).select("row", "first", "n").unionAll(edges)


def removed_spans(docs: DataFrame, keep_bytes: bool = False, hot_from: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text), null texts being empty.

    Every byte in a string of ``LENGTH`` bytes that also starts anywhere else is removed: copies and rows that are
    repeated lose such bytes too. With ``keep_bytes`` also spans (first, end) and kept (the bytes that stay).
    """
    texts, runs = repeated_windows(docs, hot_from)
    by_row = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, packed, runs in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("runs").to_pylist()):
                data, spans = unpacked(packed), []
                for run in runs or []:
                    first, end = run["first"], run["first"] + run["n"] - 1 + LENGTH
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([first, end])
                cuts = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                row = (doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, spans, kept) if keep_bytes else row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * keep_bytes
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.list_(pa.int64())), pa.binary()] * keep_bytes
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * keep_bytes
    return texts.join(by_row, "row", "left").select("doc_id", "packed", "runs").mapInArrow(remove, fields)
