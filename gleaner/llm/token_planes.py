"""Token ids in bit or byte planes: blocks of a fixed number of ids, transposed, each plane compressed with zstandard.

A file set has two Parquet tables. ``blocks``: shard, block, n_ids, kind ('byte' or 'bit'), planes (array of zstd frames)
and the documents that touch the block (doc_id, start within the shard, n_tokens). ``chunks``, the chunk index: shard,
block, first (number of the block's first id in the whole set), n_ids, n_bytes. Shards follow each other in doc_id
order, and so do documents within a shard; each block can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import text_or_empty
from .encoding import chunks, encoder

BLOCK_IDS = 1 << 16
LEVEL = 3
BLOCKS = ("shard int, block int, n_ids int, kind string, planes array<binary>, doc_ids array<bigint>, "
          "doc_starts array<bigint>, doc_tokens array<bigint>")


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """Planes of unsigned 32-bit ids: four byte planes, or 32 bit planes from the lowest bit up."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [pack(np.ascontiguousarray(rows[:, b]).tobytes()) for b in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [pack(np.packbits(np.ascontiguousarray(bits[:, b]), bitorder="little").tobytes()) for b in range(32)]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if kind == "byte":
        rows = np.stack([np.frombuffer(unpack(p, max_output_size=n_ids), np.uint8) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n_ids, bitorder="little") for p in planes]
        rows = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, vocabulary: str, spaces: bool = True, end_id: int = 0, block_ids: int = BLOCK_IDS,
              kind: str = "byte") -> None:
    """Encodes ``docs`` (doc_id, text) and writes their ids, ``end_id`` behind each document, in ascending doc_id order.

    Null texts are empty; a null doc_id comes first; rows of one doc_id are ordered by text. An empty table gives empty
    tables. One pass encodes and writes; a task holds one block and one batch of rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens = TaskContext.get().partitionId(), encoder(vocabulary, spaces)
        end, held, n_held, block, total, open_docs = np.array([end_id], np.uint32), [], 0, 0, 0, []

        def emit(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal open_docs, block
            first, last = block * block_ids, block * block_ids + len(ids)
            inside = [d for d in open_docs if d[1] < last]
            row = {"shard": [shard], "block": [block], "n_ids": [len(ids)], "kind": [kind], "planes": [to_planes(ids, kind)],
                   "doc_ids": [[d[0] for d in inside]], "doc_starts": [[d[1] for d in inside]],
                   "doc_tokens": [[d[2] for d in inside]]}
            open_docs = [d for d in open_docs if d[1] + d[2] > last]
            block += 1
            assert first < last
            return pa.RecordBatch.from_pydict(row, schema=SCHEMA)

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                for doc_id, ids in zip(doc_ids[a:b], tokens.encode(texts[a:b])):
                    open_docs.append((doc_id, total, len(ids) + 1))
                    held += [ids, end]
                    n_held += len(ids) + 1
                    total += len(ids) + 1
                    if n_held >= block_ids:
                        flat = np.concatenate(held)
                        full = n_held // block_ids * block_ids
                        for at in range(0, full, block_ids):
                            yield emit(flat[at:at + block_ids])
                        held, n_held = [flat[full:].copy()], n_held - full
        if n_held:
            yield emit(np.concatenate(held))

    SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("kind", pa.string()),
                        ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())),
                        ("doc_starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    listed = blocks.select("shard", "block", "n_ids", size.alias("n_bytes"))
    # one row per shard, that is per task of the writing stage
    shards = listed.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
    before = shards.select("shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    (listed.withColumn("within", within).join(before, "shard")
     .select("shard", "block", (F.col("base") + F.col("within")).alias("first"), "n_ids", "n_bytes")
     .write.parquet(f"{path}/chunks"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, block int, first long, n_ids int, n_bytes long").parquet(f"{path}/chunks")


def _parts(spark: SparkSession, path: str, block_ids: int, last: tuple[str, str, pa.DataType], of: Callable[[np.ndarray, int], object],
           blocks: DataFrame | None = None) -> DataFrame:
    """A row per document and block: shard, doc_start, doc_id, n_tokens, at, and ``of`` its ids and the ids behind them."""
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if blocks is not None:
        stored = stored.join(blocks.select("shard", "block"), ["shard", "block"], "left_semi")
    name, sql_type, arrow_type = last

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, first, out = from_planes(row["planes"], row["n_ids"], row["kind"]), row["block"] * block_ids, []
                for doc_id, start, n in zip(row["doc_ids"], row["doc_starts"], row["doc_tokens"]):
                    a, b = max(start, first), min(start + n, first + row["n_ids"])
                    out.append((row["shard"], start, doc_id, n, a - start, of(ids[a - first:b - first], start + n - b)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["shard", "doc_start", "doc_id", "n_tokens", "at", name]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), arrow_type]
    return stored.mapInArrow(decode, f"shard int, doc_start long, doc_id long, n_tokens long, at long, {name} {sql_type}")


def read_ids(spark: SparkSession, path: str, blocks: DataFrame | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The ids read back, one row per document and block: ``at`` is where the part starts in its document.

    ``blocks`` (shard, block) restricts reading to some blocks of the chunk index.
    """
    return _parts(spark, path, block_ids, ("ids", "binary", pa.binary()), lambda ids, behind: ids.tobytes(), blocks)


POLYNOMIAL = 0xEDB88320  # fixed: that of zlib's crc32, reflected


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC polynomial."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What ``crc`` of a part adds, by exclusive or, to the CRC of a whole in which ``n_bytes`` follow the part."""
    power, square = 1 << 31, 1 << 23  # x^0 and x^8
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, square)
        square, n_bytes = _times(square, square), n_bytes >> 1
    return _times(crc, power)


def document_sums(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored blocks.

    CRCs of a document's parts are joined by their algebra, so that a long document never meets in one task.
    """
    parts = _parts(spark, path, block_ids, ("crc", "long", pa.int64()), lambda ids, behind: crc_before(zlib.crc32(ids.tobytes()), 4 * behind))
    docs = parts.groupBy("shard", "doc_start", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    bases = read_chunks(spark, path).groupBy("shard").agg(F.min("first").alias("base"))
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")
