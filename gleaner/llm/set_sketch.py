"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Register i holds the truncated, exponentially spaced level of the smallest
of the set's i-th hash values, so sketches of parts merge by the larger register, and equal registers tell similarity.
Documents with equal bands of registers share a bucket. Each document is held against the first one of its buckets; in
buckets whose documents are still in more than one component, those outside the largest are held against all others in
blocks. A pair goes on if its sizes allow the similarity and if the joint likelihood of its registers does not rule it
out. Across components the sets of 64-bit hashes decide in the same task, so that pairs are not written. Links hold only
if the full sets, compared word by word, agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, stored, text_or_empty
from .components import component_roots

WORDS, SIMILARITY = 3, 0.85
REGISTERS, ROWS = 256, 6  # 42 bands: a pair of similarity 0.85 shares none with probability 2e-9
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2  # registers of 16 bits; sets of up to about 10^27 shingles
DOUBT = 25.0  # twice the log-likelihood a pair may lack at the similarity: five standard deviations
ODD = np.random.default_rng(20240607).integers(1 << 30, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
BLOCK, PARTNERS = 512, 64


def words_in(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str, size: int = WORDS) -> set[tuple[bytes, ...]]:
    words = words_in(text)
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def hashed_sets(texts: pa.Array, size: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text the distinct 64-bit hashes of its shingles, and a hash of its words in order (0 without words)."""
    from xxhash import xxh3_64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    word = pc.not_equal(flat, "")
    coded = flat.filter(word).dictionary_encode()
    length = np.bincount(parent.filter(word).to_numpy(), minlength=len(texts))
    known = np.array([xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    sets, keys, at = [], np.zeros(len(texts), np.uint64), 0
    for i, n in enumerate(length):
        own = hashes[at:at + n]
        at += n
        if n:
            keys[i] = xxh3_64_intdigest(own.tobytes()) or 1
        codes = np.full(min(1, n) if n <= size else n - size + 1, min(n, size), np.uint64)
        for k in range(min(n, size)):
            codes = (codes ^ (codes >> SHIFT)) * MIX + own[k:k + len(codes)]
        sets.append(np.unique((codes ^ (codes >> SHIFT)) * MIX))
    return sets, keys


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, registers): the sketches of non-empty sets of 64-bit hashes."""
    size = np.array([len(x) for x in sets])
    # 32 bits are enough: what the registers let pass is compared exactly
    codes, cuts = (np.concatenate(sets) >> SHIFT).astype(np.uint32), np.cumsum(size) - size
    least, held = np.empty((REGISTERS, len(sets)), np.uint32), np.empty_like(codes)
    for out, odd in zip(least, ODD):
        np.minimum.reduceat(np.multiply(codes, odd, out=held), cuts, out=out)
    waiting = -np.log1p(-(least.T + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(waiting) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """(sketches, bands): one 64-bit key per band."""
    rows = drawn[:, :BANDS * ROWS].reshape(len(drawn), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * MIX
    for k in range(ROWS):
        key = (key ^ rows[:, :, k]) * MIX
        key ^= key >> np.uint64(29)
    return key


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, u: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of a similarity, from the registers larger and smaller in a set that has the share u of both sizes."""
    up, down = _share(u - (1 - u) * similarity), _share(1 - u - u * similarity)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))


def least_equal(similarity: float) -> float:
    """Equal registers that a pair of the similarity falls short of by more than six standard deviations only."""
    return REGISTERS * similarity - 6 * np.sqrt(REGISTERS * similarity * (1 - similarity))


def plausible(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sizes and registers leave room for ``similarity`` or more."""
    fits = (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9) & (REGISTERS - more - less >= least_equal(similarity))
    at = np.flatnonzero(fits)  # the likelihood is worked out for what is left
    if not len(at):
        return fits
    more, less, u = more[at], less[at], size_a[at] / (size_a[at] + size_b[at])
    upper = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)  # no more than the ratio of the sizes
    best = np.full(len(u), -np.inf)
    for step in range(1, 41):
        best = np.maximum(best, log_likelihood(more, less, u, upper * step / 40))
    there = np.full(len(u), -np.inf)
    for step in range(9):
        there = np.maximum(there, log_likelihood(more, less, u, np.minimum(similarity + (1 - similarity) * step / 8, upper)))
    fits[at] = 2 * (best - there) <= DOUBT
    return fits


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key (hashes of the text and of its words in order), n_shingles, sketch and bands of every row of ``docs``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(sizes >> 19)) + 1), len(batch)]  # about half a megabyte, to stay in a core's cache
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield signed(batch.slice(low, high - low))

    def signed(part: pa.RecordBatch) -> pa.RecordBatch:
        sets, keys = hashed_sets(part.column("text"))
        size = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(size)
        drawn = registers([sets[i] for i in some]) if len(some) else np.zeros((0, REGISTERS), np.uint16)
        sketch, bands = np.full(len(sets), None), np.full(len(sets), None)
        for i, own, keys_of in zip(some, drawn, band_keys(drawn).view(np.int64)):
            sketch[i], bands[i] = own.tobytes(), keys_of
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(keys.view(np.int64)), pa.array(size), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "key", "n_shingles", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_key long, key long, n_shingles long, sketch binary, bands array<long>")


def _compared(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Registers larger in a, and larger in b, of pairs of sketches."""
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
    return (x > y).sum(axis=1), (x < y).sum(axis=1)


def _star_pairs(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Plausible pairs (a, b), a < b, of every node with one of its buckets' smallest nodes, that of most of its buckets."""
    first = members.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = members.join(first, "bucket").where("node > a").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"))
    pairs = met.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    fits = (F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9)
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(fits)

    @F.pandas_udf("boolean")
    def likely(n_a: pd.Series, n_b: pd.Series, s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        more, less = _compared(s_a, s_b)
        return pd.Series(plausible(more, less, n_a.to_numpy(np.float64), n_b.to_numpy(np.float64), similarity))

    return met.where(likely("n_a", "n_b", "s_a", "s_b")).select("a", "b")


def _hash_sets(texts: DataFrame) -> DataFrame:
    """node, hashes (the sorted 64-bit hashes of its shingles) of texts (node, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, _ = hashed_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(hashed, "node long, hashes binary")


def _links_of(i: int, at: np.ndarray, equal: np.ndarray, sets: list[np.ndarray], root: np.ndarray, joined: dict[int, int], percent: int) -> list[int]:
    """Those of ``at`` that i must be linked with to be in one component with all it is similar to; ``joined`` takes them."""

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    links, at = [], at[np.argsort(-equal, kind="stable")]
    for low in range(0, len(at), PARTNERS):
        mine = top(root[i])
        part = [j for j in at[low:low + PARTNERS].tolist() if top(root[j]) != mine]
        if not part:
            continue
        sizes = np.array([len(sets[j]) for j in part])
        theirs = np.concatenate([sets[j] for j in part])
        place = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][place] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
        for j in np.flatnonzero(100 * both >= percent * (len(sets[i]) + sizes - both)).tolist():
            mine, other = top(root[i]), top(root[part[j]])
            if mine != other:
                joined[max(mine, other)] = min(mine, other)
                links.append(part[j])
    return links


def _cross_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) across components in the same bucket, by sketches and then by sets of hashes in the same task.

    A pair is looked at once, in the first bucket its nodes share: they are of two components there, too, so one of them
    asks. Of the links of two blocks those are told that join something new, so no more than there are rows; blocks are of
    bounded size in documents and shingles.
    """
    placed = members.join(roots, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    many = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    placed = stored(placed.join(many, "bucket", "left_semi"), "placed")
    sets = _hash_sets(texts.join(placed.select("node").distinct(), "node", "left_semi"))
    known = stored(sets.join(nodes.select("node", "sketch"), "node"), "sets")
    sizes = placed.groupBy("bucket", "root").agg(F.sum(1 + F.col("n_shingles") / 1024).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1))
    main = main.select("bucket", F.col("top.root").alias("main"), blocks(F.col("all")).alias("held_blocks"), blocks(F.col("all") - F.col("top.n")).alias("ask_blocks"))
    rows = placed.join(main, "bucket").join(known, "node")
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = ["bucket", "node", "root", "main", "n_shingles", "sketch", "hashes"]
    held = rows.select(*base, F.lit(False).alias("asks"), spread("held_blocks").alias("held"), every("ask_blocks").alias("ask"))
    asks = rows.where("root <> main").select(*base, F.lit(True).alias("asks"), spread("ask_blocks").alias("ask"), every("held_blocks").alias("held"))

    enough, percent = least_equal(similarity), round(similarity * 100)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie side by side; the last one of a batch, of two blocks at most, waits for the next batch."""
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            asks, node, root, main, size = (rows[c].to_numpy() for c in ("asks", "node", "root", "main", "n_shingles"))
            keys = rows[["bucket", "ask", "held"]].to_numpy()
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            ends = [*begin[1:].tolist(), len(rows)]
            whole = len(begin) if batch is None else len(begin) - 1
            table = np.frombuffer(b"".join(rows.sketch), np.uint16).reshape(len(rows), REGISTERS)
            sets = [np.frombuffer(h, np.uint64) for h in rows.hashes]
            bands = band_keys(table).view(np.int64)
            band = (bands[begin] == keys[begin, :1]).argmax(axis=1).tolist()
            a, b = [], []
            for low, high, earlier in zip(begin[:whole].tolist(), ends, band):
                joined: dict[int, int] = {}
                kept = low + np.flatnonzero(~asks[low:high])
                for i in (low + np.flatnonzero(asks[low:high])).tolist() if len(kept) else ():
                    at = kept[(root[kept] != root[i]) & ((root[kept] == main[kept]) | (node[kept] < node[i]))]
                    at = at[(table[at] == table[i]).sum(axis=1, dtype=np.int16) >= enough]
                    at = at[~(bands[at, :earlier] == bands[i, :earlier]).any(axis=1)]
                    if not len(at):
                        continue
                    more, less = (table[i] > table[at]).sum(axis=1), (table[i] < table[at]).sum(axis=1)
                    ok = plausible(more, less, np.full(len(at), size[i], np.float64), size[at].astype(np.float64), similarity)
                    links = _links_of(i, at[ok], (REGISTERS - more - less)[ok], sets, root, joined, percent)
                    a += [node[i]] * len(links)
                    b += node[links].tolist()
            held = None if batch is None else rows.iloc[begin[-1]:].reset_index(drop=True)
            yield pd.DataFrame({"node": np.array(a, np.int64), "other": np.array(b, np.int64)})

    rows = asks.unionByName(held).repartition("bucket", "ask", "held").sortWithinPartitions("bucket", "ask", "held")
    found = rows.mapInPandas(compare, "node long, other long")
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose full shingle sets have ``similarity``; texts: node, text.

    Partners of one node are dealt out in groups; its own text travels once with each group.
    """
    percent = round(similarity * 100)
    groups = pairs.groupBy("a").agg((F.floor(F.count("*") / PARTNERS) + 1).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("deal"))
    others = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "deal", F.lit(1).alias("turn"), "b", "text")
    own = dealt.select("a", "deal").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "deal", F.lit(0).alias("turn"), F.col("a").alias("b"), "text")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: set = set()
        for batch in batches:
            a, b = [], []
            for x, turn, y, text in batch[["a", "turn", "b", "text"]].itertuples(index=False, name=None):
                theirs = shingle_set(text, size)
                if turn == 0:  # a group begins with the node's own text
                    mine = theirs
                    continue
                both = len(mine & theirs)
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": a, "b": b})

    rows = own.unionByName(others).repartition("a", "deal").sortWithinPartitions("a", "deal", "turn")
    return rows.mapInPandas(judge, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Null, empty and blank texts have an empty set, link with nothing and stay. Texts of equal words are one node, whatever
    their number. Rows with a null doc_id are linked as others and passed over for component_id; a component of such rows
    alone has a null one; their kept is false. Columns but doc_id and text are not read. Equality of word sequences is
    that of 64-bit hashes.
    """
    signed = stored(sketches(docs), "sketches")
    nodes = signed.where("sketch IS NOT NULL").groupBy(F.col("key").alias("node")).agg(
        F.min("doc_id").alias("first"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("holder"), "text_key")).alias("from"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    members = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # of buckets with the same nodes, told by two 64-bit hashes of them, the one of the first band is enough
    same = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"nodes{seed}") for seed in (1, 2)]
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("band").alias("band"), *same).where("n > 1")
    shared = shared.groupBy("n", "nodes1", "nodes2").agg(F.min_by("bucket", F.struct("band", "bucket")).alias("bucket")).select("bucket")
    members = stored(members.drop("band").join(shared, "bucket", "left_semi"), "members")
    met = nodes.join(members.select("node").distinct(), "node").select("node", "from.holder", "from.text_key")
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("holder"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    texts = stored(body.join(met, ["holder", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")
    roots = _linked(nodes, members, texts, similarity)
    named = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select(F.col("node").alias("key"), "component_id")
    out = signed.select("doc_id", "key", "n_shingles").join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _linked(nodes: DataFrame, members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """node, root of what is linked: by stars, then across the components these make."""
    edges = None
    for pairs in (lambda roots: _star_pairs(members, nodes, similarity), lambda roots: _cross_links(members, nodes, texts, roots, similarity)):
        roots = None if edges is None else component_roots(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "sketch-roots")
        found = stored(verified(stored(pairs(roots), "pairs"), texts, similarity), "links")
        edges = found if edges is None else edges.unionAll(found)
    return component_roots(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "sketch-roots")
