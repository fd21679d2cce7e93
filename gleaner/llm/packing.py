"""Best-fit packing by a linear grouping scheme, planned on the histogram of piece lengths.

A length is a whole number up to the sequence size, so the histogram, and with it the plan, is bounded by that size
however many documents there are. The driver rounds large lengths up within groups of equal cardinality, optimises how
often each configuration of rounded lengths is used (column generation over a knapsack), substitutes actual lengths
and best-fits the rest. The plan says, for ranges of the documents of one length, which range of sequences they enter
and where; tasks look up their documents by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, text_or_empty
from .encoding import chunks, encoder

CAPACITY = 2048
GROUPS = 32  # rounded sizes
SMALL = (2, 3)  # lengths over capacity / s are large, for the s of these that needs fewest sequences

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, vocabulary: str, spaces: bool = False, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, ``end_id`` behind each document; only longer ones are cut.

    ``nth`` counts the pieces of one length within their task. A null text is empty, so every row has a piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, end, task = encoder(vocabulary, spaces), np.zeros(capacity + 1, np.int64), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], tokens.encode(texts[a:b])):
                    ids = np.concatenate((ids, end)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity].tobytes()
                        size = len(part) // 4
                        rows.append((doc_id, n, at, size, zlib.crc32(part), task, int(seen[size]), *([part] if keep_ids else [])))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def group_sizes(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Each length's rounded size: the largest length of its group, groups holding about equally many pieces."""
    total, seen, out, top = sum(counts.values()), 0, {}, {}
    for length in sorted(counts, reverse=True):
        group = seen * groups // total
        out[length] = top.setdefault(group, length)
        seen += counts[length]
    return out


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits ``capacity`` and is worth most."""
    best, choice, at = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.array(sizes)
    order = np.argsort(at)
    at, value = at[order], worth[order]
    for room in range(int(at[0]), capacity + 1):
        n = int(np.searchsorted(at, room, "right"))
        got = best[room - at[:n]] + value[:n]
        k = int(got.argmax())
        best[room] = best[room - 1]
        if got[k] > best[room] + 1e-12:
            best[room], choice[room] = got[k], k
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            out[order[choice[room]]] += 1
            room -= int(at[choice[room]])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1_000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used in full, for a near-minimal number of sequences."""
    n, d = len(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(n))
        value, column = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        used, step = np.linalg.solve(basis, d), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.maximum(step, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = column
    used = np.linalg.solve(basis, d)
    return [(basis[:, k].astype(int), int(used[k] + 1e-6)) for k in range(n) if used[k] >= 1 - 1e-6]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): the ``count`` pieces of a length from a rank on enter
    consecutive sequences at the same offset. Their number depends on ``capacity`` alone."""
    return min((plan_with(counts, capacity, groups, s) for s in small), key=lambda moves: int((moves[:, 3] + moves[:, 2]).max(initial=0)))


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: int) -> np.ndarray:
    """The plan in which lengths over ``capacity / small`` are large."""
    counts = {n: c for n, c in counts.items() if c}
    moves: list[tuple[int, int, int, int, int]] = []
    taken, next_sequence = dict.fromkeys(counts, 0), 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of sequences (first, count)
    levels: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                insort(levels, room)
            rooms[room].append((first, n))

    def take(length: int, n: int, first: int, room: int) -> None:
        moves.append((length, taken[length], n, first, capacity - room))
        taken[length] += n

    large = {n: c for n, c in counts.items() if n > capacity // small}
    if large:
        rounded = group_sizes(large, groups)
        members: dict[int, list[int]] = {}
        for n in sorted(large, reverse=True):
            members.setdefault(rounded[n], []).append(n)
        sizes = sorted(members, reverse=True)
        left = {s: sum(large[n] for n in members[s]) for s in sizes}
        for column, times in configurations(sizes, [left[s] for s in sizes], capacity):
            slots = [s for s, k in zip(sizes, column) for _ in range(k)]
            times = min([times, *(left[s] // k for s, k in zip(sizes, column) if k)])
            if times <= 0:
                continue
            runs = [(next_sequence, times, capacity)]
            next_sequence += times
            for s in slots:
                left[s] -= times
                after = []
                for first, n, room in runs:
                    while n:
                        while taken[members[s][0]] == large[members[s][0]]:
                            members[s].pop(0)
                        length = members[s][0]
                        now = min(n, large[length] - taken[length])
                        take(length, now, first, room)
                        after.append((first, now, room - length))
                        first, n = first + now, n - now
                runs = after
            for first, n, room in runs:
                put(room, first, n)
    for length in sorted(counts, reverse=True):
        n = counts[length] - taken[length]
        while n:
            k = bisect_left(levels, length)
            if k == len(levels):
                fresh = -(-n // (capacity // length))
                put(capacity, next_sequence, fresh)
                next_sequence += fresh
                continue
            room = levels[k]
            first, free = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], levels[k]
            now = min(n, free)
            take(length, now, first, room)
            put(room - length, first, now)
            put(room, first + now, free - now)
            n -= now
    out = np.array(moves, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> DataFrame:
    """Pieces with sequence_id and offset (gapless from 0); ``cut`` is what ``pieces`` returned, stored."""
    counted = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = plan(histogram, capacity, groups, small)
    before = counted.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    keys = (moves[:, 0] << 44) + moves[:, 1]
    rest = [c for c in cut.columns if c not in ("task", "nth")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            move = moves[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [pa.array(move[:, 3] + rank - move[:, 1]), pa.array(move[:, 4])], names=[*rest, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*rest).schema)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, spaces: bool = False, end_id: int = 0, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, vocabulary, spaces, end_id, capacity), "pieces"), capacity, groups)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, from pieces that carry their ids; a group is one sequence."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
