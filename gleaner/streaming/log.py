"""A keyed table kept as an append-only log of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import latest_per_key


class KeyedLog:
    """Rows are written to one folder per batch; a replayed batch overwrites its own folder only.

    Writing costs what the batch costs, whatever the size of the table. Readers take the last row per key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType | str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        # an empty folder makes the table readable before its first batch
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/batch=-1")

    def write(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self, before: int | None = None, number: int | None = None) -> DataFrame:
        """All rows with their batch; ``before`` leaves out that batch and later ones, ``number`` gives one batch alone."""
        schema = StructType(list(self.schema.fields)).add("batch", "long")
        df = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        if number is not None:
            return df.where(F.col("batch") == number)
        return df if before is None else df.where(F.col("batch") < before)

    def latest(self, order: Sequence[str] = (), before: int | None = None) -> DataFrame:
        """Last row per key by the caller's order; the batch only settles ties, as changes may come late."""
        return latest_per_key(self.rows(before), self.keys, [*order, "batch"]).drop("batch")
