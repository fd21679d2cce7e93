"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints within d bits agree on at least one of d + 1 parts of their bits, so equal values of one part make the
groups that tasks take; a group with many fingerprints is split the same way by its remaining bits, and so on, which
bounds it without losing a link. In a group the fingerprints are sorted by Gray rank and every run of them is a node
that holds the bits all its members share and no node above it holds. A search adds up a query's differences with
these shared bits and leaves whole runs once they pass the limit, or once all their members are already linked to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_or_empty
from .components import component_roots

BITS, DISTANCE, WORDS, SEED = 64, 2, 3, 42
FANOUT = 16
SPLIT_OVER = 1_024  # fingerprints of a group before it is split by further bits

SEPARATORS = bytes([32, 9, 10, 11, 12, 13])
BLANKS = bytes.maketrans(SEPARATORS, b" " * 6)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the text's word shingles by XXH64; bit set if in over half of them; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().translate(BLANKS).split(b" ") if text else []
    parts = [p for p in parts if p]
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), seed)
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-words]]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:])], np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTE_OFFSET).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ BYTE_BITS) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


BYTE_OFFSET = np.arange(8, dtype=np.int64) * 256
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Nodes over runs of ``fanout`` children, from the fingerprints up to one root."""

    def __init__(self, prints: np.ndarray, fanout: int = FANOUT):
        self.prints, self.fanout = prints[np.argsort(gray_rank(prints))], fanout
        ones, anys, shared = self.prints, self.prints, []
        while True:
            shared.append((ones, ~(ones ^ anys)))  # pattern, and the bits on which all members agree
            if len(ones) == 1:
                break
            cuts = np.arange(0, len(ones), fanout)
            ones, anys = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(anys, cuts)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for depth, (pattern, agreed) in enumerate(shared):
            if depth + 1 < len(shared):  # bits that the node above holds are left to it
                agreed = agreed & ~shared[depth + 1][1][np.arange(len(agreed)) // fanout]
            self.levels.append((pattern, agreed))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all members of a node have, or -1."""
        out, low, high = [labels], labels, labels
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def near(self, queries: np.ndarray, distance: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member), both places in Gray order, within ``distance``; with labels, not those that share one."""
        q, node, sum_ = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint8)
        same = self.uniform(labels) if labels is not None else None
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, agreed = self.levels[depth]
            if depth < len(self.levels) - 1:
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, sum_ = np.repeat(q, self.fanout), np.repeat(sum_, self.fanout)
                there = node < len(pattern)
                q, node, sum_ = q[there], node[there], sum_[there]
            sum_ = sum_ + np.bitwise_count((self.prints[q] ^ pattern[node]) & agreed[node])
            stay = sum_ <= distance
            if same is not None:
                stay &= same[depth][node] != labels[q]
            q, node, sum_ = q[stay], node[stay], sum_[stay]
        return q, node

    def links(self, distance: int) -> np.ndarray:
        """A spanning forest, rows of two places, of the members linked within ``distance``."""
        n, found = len(self.prints), []
        labels, at, step = np.arange(n), 0, 8
        while at < n:
            q, m = self.near(np.arange(at, min(n, at + step)), distance, labels)
            reached = len(q)
            if reached:
                edges = _merge(labels, q, m)
                found.append(edges)
            at, step = at + step, min(256, step * 2) if reached < 1 << 16 else max(1, step // 2)
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of each pair in ``labels`` (smallest place); returns the pairs that joined something."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    used = []
    la, lb = labels[a], labels[b]
    _, first = np.unique(np.minimum(la, lb) * len(labels) + np.maximum(la, lb), return_index=True)
    for i in first:
        x, y = root(int(la[i])), root(int(lb[i]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(i)
    old = np.array(sorted(parent), np.int64)
    if len(old):
        new = np.array([root(int(x)) for x in old])
        place = np.minimum(np.searchsorted(old, labels), len(old) - 1)
        hit = old[place] == labels
        labels[hit] = new[place[hit]]
    return np.stack((a[used], b[used]), axis=1)


def part_masks(bits: list[int], parts: int) -> list[int]:
    """``bits`` dealt into ``parts`` masks of neighbouring bits."""
    return [sum(1 << b for b in bits[len(bits) * k // parts:len(bits) * (k + 1) // parts]) for k in range(parts)]


def near_links(prints: DataFrame, distance: int = DISTANCE, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``prints`` (fingerprint long) that connect whatever is within ``distance`` bits.

    Groups are (mask, value) of the bits that must agree. Those over ``split_over`` are split by parts of the bits they
    do not fix yet, until none is left over or every bit is fixed but the last few.
    """
    parts, tasks = distance + 1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_group(rows: pd.DataFrame) -> pd.DataFrame:
        index = GrayIndex(rows.fingerprint.to_numpy().view(np.uint64))
        found = index.prints[index.links(distance)].view(np.int64)
        return pd.DataFrame({"u": found.min(axis=1), "v": found.max(axis=1)})

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(0, m) for m in part_masks(list(range(BITS)), parts)]
    level, out = prints.select(F.lit(0).cast("long").alias("mask"), "fingerprint"), None
    while masks:
        choices = F.create_map(*[x for above in {a for a, _ in masks} for x in (
            F.lit(signed(above)), F.array(*[F.lit(signed(a | m)) for a, m in masks if a == above]))])
        rows = level.select("fingerprint", F.explode(choices[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        rows = stored(rows.join(counts, ["mask", "value"]), "gray")
        deeper = [(above | m) for above, m in masks if BITS - (above | m).bit_count() > 16]
        deep = F.col("mask").isin([signed(m) for m in deeper]) & (F.col("n") > split_over) if deeper else F.lit(False)
        # by number, so that small but slow groups are not put together in one task
        links = rows.where(~deep).repartition(tasks, "mask", "value").groupBy("mask", "value").applyInPandas(by_group, "u long, v long")
        out = links if out is None else out.unionAll(links)
        level = rows.where(deep).select("mask", "fingerprint").distinct()
        if not deeper or level.isEmpty():
            break
        masks = [(a, m) for a in deeper for m in part_masks([b for b in range(BITS) if not a >> b & 1], parts)]
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, key (hash of the text) and fingerprint (as a signed long) of every row; null texts have no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], names=["doc_id", "key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(each, "doc_id long, key long, fingerprint long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, seed: int = SEED, split_over: int = SPLIT_OVER,
                    with_key: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most ``distance`` bits).

    Texts without words have fingerprint zero and are linked like any other; null ids are passed over for component_id.
    ``with_key`` adds key, the hash of the text, and root, a number that the rows of a component share.
    """
    prints = stored(fingerprints(docs, words, seed), "prints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = component_roots(near_links(distinct.select("fingerprint"), distance, split_over), "gray").select(
        F.col("node").alias("fingerprint"), "root")
    named = stored(distinct.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "gray")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fingerprint", "root", "component_id")
    return prints.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", *(["key", "root"] if with_key else []))
