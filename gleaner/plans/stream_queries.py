"""Streams over the driver tables, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..streaming import jobs
from ..streaming.log import KeyedLog
from . import base, oracle as O
from .registry import query


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    # as a pattern the path may be one file or a folder of files
    return jobs.file_stream(spark, f"{path}*", spark.read.parquet(path).schema)


def _finish(q) -> None:
    q.awaitTermination()


def _in_parts(spark, rows, part, start, parts=3):
    """Runs the stream over ``rows`` in turn by ``part`` (0, 1, ...): several batches, and a restart before all but the first.

    ``rows`` are worked out and landed once, in a folder per part; a start sees the folders that have come by then.
    """
    folder, schema = scratch_folder(spark, "landed"), rows.schema
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(folder)
    for n in range(parts):
        come = ",".join(str(i) for i in range(n + 1))
        _finish(start(jobs.file_stream(spark, f"{folder}/_part={{{come}}}", schema)))


def _by_day(ts, *starts):
    """Number of the part a time belongs to: parts begin on these days of the tables' first month."""
    return sum(((ts >= F.lit(f"2024-01-{d:02d}").cast("timestamp")).cast("int") for d in starts), F.lit(0))


@query("st_ingest", f"""
WITH won AS (SELECT article_id, feed_id, CASE WHEN norm_len < 32 OR first_id = article_id THEN 'insert' ELSE 'content' END AS gate, title, content_text, fetched_at
  FROM raw_articles JOIN firsts USING (content_hash)),
tag AS (SELECT article_id, count(*) AS n FROM article_topics GROUP BY 1)
SELECT article_id, feed_id, gate, CASE gate WHEN 'insert' THEN coalesce(n, 0) ELSE 0 END AS n_topics, CASE gate WHEN 'insert' THEN 2 ELSE 0 END::BIGINT AS n_tasks,
  CASE gate WHEN 'insert' THEN len({O.tok("title || ' ' || content_text")}) ELSE 0 END::BIGINT AS dl, CASE gate WHEN 'insert' THEN {O.words('content_text')} END::BIGINT AS word_count
FROM won LEFT JOIN tag USING (article_id)""")
def st_ingest(spark, sf):
    """Articles, audit, topics, tasks and index after three batches, with a restart in between, are those of one batch job."""
    items = base.raw_articles(spark, sf).select("article_id", "feed_id", "source_url", "title", "content_text", "fetched_at")
    store, ckpt = jobs.ArticleStore(spark, scratch_folder(spark, "store")), scratch_folder(spark, "ckpt")
    topics = base.topics(spark)
    _in_parts(spark, items, _by_day(F.col("fetched_at"), 2, 3), lambda stream: jobs.start_ingest(stream, store, topics, ckpt))
    zero = F.lit(0).cast("long")
    tags = store.topics.rows().groupBy("article_id").agg(F.count("*").alias("n_topics"))
    tasks = store.tasks.rows().groupBy("article_id").agg(F.count("*").alias("n_tasks"))
    sizes = store.index().docs().select(F.inline(F.arrays_zip("docs", "dls"))).select(F.col("docs").alias("article_id"), F.col("dls").cast("long").alias("dl"))
    new = store.articles.rows().select("article_id", "feed_id", F.lit("insert").alias("gate"), "word_count").join(tags, "article_id", "left").join(tasks, "article_id", "left").join(sizes, "article_id")
    hits = store.audit.rows().select("article_id", "feed_id", "gate", zero.alias("n_topics"), zero.alias("n_tasks"), zero.alias("dl"), F.lit(None).cast("long").alias("word_count"))
    return new.select("article_id", "feed_id", "gate", F.coalesce("n_topics", zero).alias("n_topics"), "n_tasks", "dl", "word_count").unionByName(hits)


@query("st_dedup", """
WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts::TIMESTAMP) * 5 AS t FROM events),
w AS (SELECT user_id, event_type, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM e GROUP BY 1, 2
  UNION ALL SELECT user_id, event_type, arg_min(e.event_id, (e.t, e.event_id)), min(e.t) FROM w JOIN e USING (user_id, event_type) WHERE e.t >= w.t + 2592000000000 GROUP BY 1, 2, w.t)
SELECT user_id, event_type, event_id FROM w""")
def st_dedup(spark, sf):
    """One event of a user and type in 30 days; time runs five times as fast, so that keys come back after their state is gone."""
    ts = F.col("ts").cast("timestamp")
    rows = base.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.timestamp_micros(F.unix_micros(ts) * 5).alias("ts"), ts.alias("landed"))
    table, ckpt = KeyedLog(spark, scratch_folder(spark, "kept"), ["event_id"], "user_id long, event_type string, event_id long, ts timestamp"), scratch_folder(spark, "ckpt")
    _in_parts(spark, rows, _by_day(F.col("landed"), 10, 20), lambda stream: jobs.start_dedup(stream, ["user_id", "event_type"], "ts", "event_id", table, ckpt))
    return table.rows().select("user_id", "event_type", "event_id")


def _windows(spark, sf, period):
    ts = F.col("ts").cast("timestamp")
    rows = base.table(spark, sf, "events").select("event_type", "event_id", ts.alias("ts"))
    # of the first part every 97th event comes with the last one, when its period is closed
    part = F.when((F.col("event_id") % 97 == 0) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp")), 2).otherwise(_by_day(F.col("ts"), 10, 20))
    table, ckpt = jobs.PeriodCounts(spark, scratch_folder(spark, "windows")), scratch_folder(spark, "ckpt")
    _in_parts(spark, rows, part, lambda stream: jobs.start_windows(stream, "event_type", "ts", table, ckpt, period))
    return table.counts().select(F.col("period_start").cast("string").alias("period_start"), "source", "n", "n_late")


def _windows_sql(period: str, days: int) -> str:
    return f"""
WITH e AS (SELECT event_type, ts, CASE WHEN event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-10' THEN 2 ELSE (ts >= TIMESTAMP '2024-01-10')::INT + (ts >= TIMESTAMP '2024-01-20')::INT END AS part FROM events),
seen AS (SELECT p, max(ts) AS top FROM e, (VALUES (1), (2)) v(p) WHERE part < p GROUP BY 1),
j AS (SELECT strftime(date_trunc('{period}', ts), '%Y-%m-%d') AS period_start, event_type AS source,
  coalesce(date_trunc('{period}', ts) + INTERVAL {days} DAY <= top - INTERVAL 2 DAY, false) AS late FROM e LEFT JOIN seen ON p = part)
SELECT period_start, source, count_if(NOT late)::BIGINT AS n, count_if(late)::BIGINT AS n_late FROM j GROUP BY 1, 2"""


@query("st_windows", _windows_sql("day", 1))
def st_windows(spark, sf):
    return _windows(spark, sf, "daily")


@query("st_windows_weekly", _windows_sql("week", 7))
def st_windows_weekly(spark, sf):
    return _windows(spark, sf, "weekly")


@query("st_failures", """
WITH f AS (SELECT user_id AS feed_id, event_id AS seq, event_type = 'error' AS bad FROM events),
g AS (SELECT *, count_if(NOT bad) OVER (PARTITION BY feed_id ORDER BY seq) AS grp FROM f),
r AS (SELECT feed_id, seq, CASE WHEN bad THEN count_if(bad) OVER (PARTITION BY feed_id, grp ORDER BY seq) ELSE 0 END AS streak FROM g)
SELECT feed_id, max(seq) AS seq, arg_max(streak, seq)::BIGINT AS failures, max(streak)::BIGINT AS longest_run, 0::BIGINT AS n_late FROM r GROUP BY 1""")
def st_failures(spark, sf):
    """Keyed state over three batches; some events come a batch, but less than the delay, late."""
    ts = F.col("ts").cast("timestamp")
    rows = base.table(spark, sf, "events").select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("seq"), ts.alias("ts"), (F.col("event_type") != "error").alias("ok"))
    landed = F.when(F.col("seq") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    table, ckpt = KeyedLog(spark, scratch_folder(spark, "failures"), ["feed_id"], jobs.FAILURE_SCHEMA), scratch_folder(spark, "ckpt")
    _in_parts(spark, rows, _by_day(landed, 10, 20), lambda stream: jobs.start_failures(stream, table, ckpt))
    return table.latest()


@query("st_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def st_upsert(spark, sf):
    rows = _stream(spark, sf, "events").select("user_id", "event_id", "event_type")
    table = KeyedLog(spark, scratch_folder(spark, "upsert"), ["user_id"], "user_id long, event_id long, event_type string")
    _finish(jobs.start_upsert(rows, table, ["event_id"], scratch_folder(spark, "ckpt")))
    return table.latest(["event_id"])
