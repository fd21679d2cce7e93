"""Audit log and markdown export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_events(events: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append to the audit log, one folder per day."""
    (events.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")
     .write.mode("append").partitionBy("event_date").parquet(path))


def export_pages(pages: DataFrame, path: str, name: str = "slug") -> None:
    """One JSON line per page with its name and markdown."""
    pages.select(F.col(name).alias("name"), "content_md").write.mode("overwrite").json(path)


def retain(events: DataFrame, now, days: int = 90, ts: str = "created_at") -> DataFrame:
    """Events not older than ``days``."""
    return events.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def drop_expired(spark, path: str, now, days: int = 90) -> list[str]:
    """Remove expired day folders of an audit log; only folder names are read."""
    cutoff = spark.range(1).select(F.date_sub(F.lit(now).cast("date"), days).cast("string")).first()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("event_date=") and name.split("=", 1)[1] < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone
