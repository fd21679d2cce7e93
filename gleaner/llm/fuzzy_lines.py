"""Fuzzy duplicate lines by MinHash: banded signatures of character shingles, exact Jaccard, distributed union-find.

Lines are compared without the white space at their ends; blank lines never count as copies. Equal lines share a
64-bit hash; signatures are made once per distinct line and task. A task also joins its own lines with equal bands, so
that a band shared by a great many lines meets as one entry per task, never as all its lines. Candidates are the pairs
of a bucket's lines with one of them; in buckets whose lines end up in more than one component, those outside the
largest are held against all others in blocks, so that no pair of a bucket goes unseen and no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import NO_ID, matched, stored, text_or_empty
from .components import component_roots

SHINGLE, ROWS, BANDS, SIMILARITY = 7, 5, 20, 0.8  # finds a pair of similarity 0.8 with probability 0.9996, of 0.85 with 0.99999
ODD = np.random.default_rng(20240501).integers(1 << 30, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def lines(text: str) -> list[str]:
    return text.split("\n")


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without the white space around it; 0 for a blank one."""
    from xxhash import xxh3_64_intdigest

    line = line.strip()
    h = xxh3_64_intdigest(line.encode()) if line else 0
    return h - (1 << 64) if h >> 63 else h


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    x, y = shingles(a, size), shingles(b, size)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def signatures(rows: list[str], size: int = SHINGLE) -> np.ndarray:
    """(hash functions, lines) minima of non-blank lines."""
    padded = [r if len(r) >= size else r + "\0" * (size - len(r)) for r in rows]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(r) for r in padded])
    ends = np.cumsum(length)
    rolling = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        rolling = rolling * np.uint64(1_000_003) + codes[k:len(codes) - size + 1 + k]
    rolling = (rolling ^ (rolling >> np.uint64(29))) * MIX
    rolling ^= rolling >> np.uint64(32)
    inside = np.ones(len(rolling), bool)
    for back in range(1, size):
        inside[ends[:-1] - back] = False
    # 32 bits are enough: similar lines are compared exactly
    rolling, count = (rolling[inside] >> np.uint64(32)).astype(np.uint32), length - size + 1
    cuts = np.cumsum(count) - count
    minima, hashed = np.empty((len(ODD), len(rows)), np.uint32), np.empty_like(rolling)
    for least, odd in zip(minima, ODD):
        np.minimum.reduceat(np.multiply(rolling, odd, out=hashed), cuts, out=least)
    return minima


def band_keys(rows: list[str], size: int = SHINGLE) -> np.ndarray:
    """(lines, bands) keys of non-blank lines; equal in a band when the band's minima are."""
    minima, keys = signatures(rows, size), np.zeros((len(rows), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(rows), band + 1, np.uint64)
        for least in minima[band * ROWS:(band + 1) * ROWS]:
            key = (key ^ least) * MIX
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys


def band_members(docs: DataFrame) -> DataFrame:
    """bucket, line (hash): the members of every band bucket with at least two different lines."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, buckets, members = set(), [], []

        def sign(some: list[str], ids: list[int]) -> None:
            keys = band_keys(some)
            buckets.append((((keys % np.uint64(parts)) << np.uint64(32)) | (keys >> np.uint64(32))).ravel().view(np.int64))
            members.append(np.repeat(np.array(ids, np.int64), BANDS))

        some, ids, held = [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in lines(text):
                    h = line_hash(line)
                    if h and h not in seen:
                        seen.add(h)
                        some.append(line.strip())
                        ids.append(h)
                        held += len(line)
                        if held > 1 << 16:  # arrays that stay in a core's cache
                            sign(some, ids)
                            some, ids, held = [], [], 0
        if some:
            sign(some, ids)
        if not buckets:
            return
        bucket, member = np.concatenate(buckets), np.concatenate(members)
        order = np.lexsort((member, bucket))
        bucket, member = bucket[order], member[order]
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        shared = ~first | np.concatenate((~first[1:], [False]))
        task = TaskContext.get().partitionId()
        rows = [(-1 - task, bucket[shared].tobytes(), member[shared].tobytes())]
        bucket, member = bucket[first], member[first]
        cuts = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.int64) << 32)
        rows += [(p, (bucket[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes(), member[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))], names=["part", "buckets", "members"])

    def shared_buckets(rows: pd.DataFrame) -> pd.DataFrame:
        part, member = int(rows.part.iloc[0]), np.frombuffer(b"".join(rows.members), np.int64)
        if part < 0:  # a task's own: all of them are shared
            return pd.DataFrame({"bucket": np.frombuffer(b"".join(rows.buckets), np.int64), "line": member})
        bucket = np.frombuffer(b"".join(rows.buckets), np.uint32)
        order = np.lexsort((member, bucket))
        bucket, member = bucket[order], member[order]
        start = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        group = np.cumsum(start) - 1
        at = np.flatnonzero(start)
        many = (np.minimum.reduceat(member, at) != np.maximum.reduceat(member, at))[group] if len(at) else start
        return pd.DataFrame({"bucket": bucket[many].astype(np.int64) | part << 32, "line": member[many]})

    # a group is a part of the bucket space: as many as there are shuffle partitions, one entry per bucket and task
    return docs.select(text_or_empty().alias("text")).mapInArrow(entries, "part long, buckets binary, members binary").groupBy("part").applyInPandas(
        shared_buckets, "bucket long, line long").distinct()


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """did and dkey, which tell rows apart unless both doc_id and text are equal, with the text."""
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("dkey"), text.alias("text"), *more)


def occurrences(docs: DataFrame) -> DataFrame:
    """did, dkey, n_lines and the hashes of each document's lines, 0 for blank ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[line_hash(line) for line in lines(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("dkey"), pa.array(hashes, pa.list_(pa.int64()))], names=["did", "dkey", "hashes"])

    return keyed(docs).mapInArrow(each, "did long, dkey long, hashes array<long>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, body of ``wanted`` (line, did, dkey, at): the lines at these places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                all_lines = lines(text)
                out += [(p["line"], all_lines[p["at"]].strip()) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["line", "body"])

    places = wanted.groupBy("did", "dkey").agg(F.collect_list(F.struct("at", "line")).alias("places"))
    # identical rows give identical lines
    return keyed(docs).join(places, ["did", "dkey"]).select("text", "places").mapInArrow(cut, "line long, body string").dropDuplicates(["line"])


def similar(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of lines whose shingle sets reach the similarity."""

    @F.pandas_udf("boolean")
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= similarity for x, y in zip(a, b)], dtype=bool)

    left, right = bodies.select(F.col("line").alias("u"), F.col("body").alias("a")), bodies.select(F.col("line").alias("v"), F.col("body").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(reaches("a", "b")).select("u", "v")


FEW = 64  # lines of a bucket that is looked at as a whole
ASKING, HELD = 256, 1024  # lines of a block on either side, of larger buckets


def across_components(members: DataFrame, roots: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs (u, v) of bucket members that are in different components.

    The lines outside a bucket's largest component ask, all of the bucket's lines answer. Small buckets are taken
    together, as many groups as there are shuffle partitions. Of larger ones both sides are dealt into blocks, so a task
    sees ``ASKING`` x ``HELD`` lines whatever the bucket's size. Every pair is verified exactly but those whose sizes rule
    it out, and those that edges found before in the block have joined.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = members.join(roots, "line", "left").select("bucket", "line", F.coalesce("root", "line").alias("root"))
    sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("n > 2 and top.n < n").select(
        "bucket", F.col("top.root").alias("top"), "n", F.ceil((F.col("n") - F.col("top.n")) / ASKING).alias("asking"), F.ceil(F.col("n") / HELD).alias("held"))
    rows = stored(labelled.join(mixed, "bucket").join(bodies, "line"), "mixed")
    place = lambda n: F.pmod(F.xxhash64("line", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small, large = rows.where(F.col("n") <= FEW), rows.where(F.col("n") > FEW)
    ask = large.where("root <> top").withColumn("a", place("asking")).withColumn("h", every("held"))
    answer = large.withColumn("h", place("held")).withColumn("a", every("asking"))
    cols = ["bucket", "a", "h", "line", "root", "body"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        number: dict[str, int] = {}
        mine = [np.array([number.setdefault(s, len(number)) for s in shingles(b)], np.int64) for b in left.body]
        none = len(number)  # of shingles that no asking line has
        theirs = [np.fromiter((number.get(s, none) for s in shingles(b)), np.int64) for b in right.body]
        order = np.argsort([len(t) for t in theirs], kind="stable")  # by size: the lines that can be similar stand together
        theirs, line, root = [theirs[j] for j in order], right.line.to_numpy()[order], right.root.to_numpy()[order]
        sizes = np.array([len(t) for t in theirs])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        held_ids, has = np.concatenate(theirs), np.zeros(none + 1, bool)
        own, found = left.root.to_numpy().copy(), []
        for i, ids in enumerate(mine):
            low, high = np.searchsorted(sizes, similarity * len(ids) - 1e-6, "left"), np.searchsorted(sizes * similarity, len(ids) + 1e-6, "right")
            if low >= high or (root[low:high] == own[i]).all():
                continue
            has[ids] = True
            both = np.add.reduceat(has[held_ids[ends[low]:ends[high]]], ends[low:high] - ends[low], dtype=np.int64)
            has[ids] = False
            for j in low + np.flatnonzero(both / (len(ids) + sizes[low:high] - both) >= similarity):
                joined = root[j]
                if joined != own[i]:  # those joined by now are one component
                    found.append((left.line.iloc[i], line[j]))
                    root[root == joined] = own[i]
                    own[own == joined] = own[i]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    def compare_small(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", kind="stable")
        line, root, top, body = rows.line.tolist(), rows.root.tolist(), rows.top.tolist(), rows.body.tolist()
        cuts = np.append(np.flatnonzero(np.diff(rows.bucket.to_numpy(), prepend=rows.bucket.iloc[0] - 1)), len(rows)).tolist()
        sets, seen, found = {}, set(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            for i in range(a, b):
                if root[i] == top[i]:
                    continue
                for j in range(a, b):
                    pair = (line[i], line[j]) if line[i] < line[j] else (line[j], line[i])
                    if root[i] == root[j] or pair in seen:
                        continue
                    seen.add(pair)
                    for k in (i, j):
                        if line[k] not in sets:
                            sets[line[k]] = shingles(body[k])
                    x, y = sets[line[i]], sets[line[j]]
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                        both = len(x & y)
                        if both >= similarity * (len(x) + len(y) - both):
                            found.append(pair)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    blocks = ask.select(*cols).groupBy("bucket", "a", "h").cogroup(answer.select(*cols).groupBy("bucket", "a", "h")).applyInPandas(compare, "u long, v long")
    dealt = small.select(F.pmod(F.xxhash64("bucket"), F.lit(parts)).alias("part"), "bucket", "line", "root", "top", "body").repartition(parts, "part")
    return dealt.groupBy("part").applyInPandas(compare_small, "u long, v long").unionAll(blocks)


def line_components(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Occurrences (did, dkey, hashes), and roots (line, root) of the lines that have a different line in their component."""
    found = stored(occurrences(docs), "lines")
    members = stored(band_members(docs), "bands")
    # another one in every band, so that a line meets several of its likes
    pivots = members.groupBy("bucket").agg(F.min_by("line", F.xxhash64("bucket", "line")).alias("u"))
    pairs = members.join(pivots, "bucket").where("line <> u").select(F.least("u", "line").alias("u"), F.greatest("u", "line").alias("v")).distinct()
    places = found.select("did", "dkey", F.posexplode("hashes").alias("at", "line"))
    wanted = members.select("line").distinct().join(places, "line").groupBy("line").agg(F.min(F.struct("did", "dkey", "at")).alias("first"))
    bodies = stored(line_texts(docs, wanted.select("line", "first.*")), "bodies")
    edges = stored(similar(pairs, bodies, similarity), "edges")
    roots = component_roots(edges, "roots").select(F.col("node").alias("line"), "root")
    more = stored(across_components(members, roots, bodies, similarity), "edges")
    if not more.isEmpty():
        roots = component_roots(edges.unionAll(more), "roots").select(F.col("node").alias("line"), "root")
    return found, roots


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """did, dkey, n_lines and dropped (line numbers from 0, ascending; null if none) of the documents.

    Of every component the first line by (doc_id, text hash, line number) stays; null ids come first. Rows equal in
    doc_id and text count as one document, so they keep the same lines.
    """
    found, roots = line_components(docs, similarity)
    whole = found.dropDuplicates(["did", "dkey"])
    places = whole.select("did", "dkey", F.posexplode("hashes").alias("at", "line")).where("line <> 0")
    firsts = places.groupBy("line").agg(F.min(F.struct("did", "dkey", "at")).alias("first"), F.count("*").alias("n"))
    named = firsts.join(roots, "line", "left").withColumn("named", F.coalesce("root", "line"))
    kept = named.groupBy("named").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    copies = named.select("line", "named").join(kept, "named").select("line", "keep")
    gone = places.join(copies, "line").where(F.struct("did", "dkey", "at") != F.col("keep"))
    return gone.groupBy("did", "dkey").agg(F.sort_array(F.collect_list("at")).alias("dropped"))


def line_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped for every row of ``docs`` (doc_id, text)."""
    gone = dropped_lines(docs, similarity)
    counted = keyed(docs).select("did", "dkey", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    return counted.join(gone, ["did", "dkey"], "left").select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """``text`` without the lines of these numbers."""
    rest = F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(dropped, at))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(rest, "\n"))


def without_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its columns and rows, copied lines removed from the texts; ``n_chars``, if there, follows."""
    out = matched(docs, dropped_lines(docs, similarity), "left")
    row = F.col("row").withField("text", without(F.col("row.text"), F.col("dropped")))
    if "n_chars" in docs.columns:
        counted = F.char_length(without(F.col("row.text"), F.col("dropped"))).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(counted))
    return out.select(row.alias("row")).select("row.*")
