"""Continuous versions of ingest, deduplication, period counts, failure state and upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import word_count
from ..operators.dedup import DAY, chain_winners, exact_dedup
from ..operators.index import write_article_index
from ..operators.postings import PostingIndex
from ..operators.ranking import latest_per_key
from ..operators.topics import match_keywords
from ..session import cut_lineage
from .log import KeyedLog


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(df: DataFrame, checkpoint: str, mode: str = "append", each=None, once: bool = True, path: str | None = None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").start(path)


ARTICLE_SCHEMA = (
    "article_id long, feed_id long, source_url string, title string, content_text string, fetched_at timestamp, "
    "url_hash string, content_hash string, short boolean, word_count long, status string, dedupe_of long"
)
NEW_TASKS = ("embed_core", "summarize")  # queued for every new article


class ArticleStore:
    """The tables that ingest keeps: articles, audit, article_topics, tasks, and the keyword index; one folder per batch each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.articles = KeyedLog(spark, f"{self.path}/articles", ["article_id"], ARTICLE_SCHEMA)
        self.audit = KeyedLog(spark, f"{self.path}/audit", ["article_id"], "feed_id long, article_id long, winner_id long, gate string")
        self.topics = KeyedLog(spark, f"{self.path}/topics", ["article_id", "topic_id"], "article_id long, topic_id long, score double, method string")
        self.tasks = KeyedLog(spark, f"{self.path}/tasks", ["article_id", "task"], "article_id long, task string, status string")

    def index(self) -> PostingIndex:
        return PostingIndex(self.spark, f"{self.path}/index")


def start_ingest(items: DataFrame, store: ArticleStore, topics: DataFrame, checkpoint: str, days: int = 30, once: bool = True) -> StreamingQuery:
    """Items into all tables of ``store``: both exact gates, word count and status, keyword index, keyword topics and first tasks.

    A batch is compared with the stored hashes of the batches before it, never with their texts, and every table's rows of
    a batch lie in that batch's folder: a replay gives the same rows again.
    """

    def batch(df: DataFrame, number: int) -> None:
        known = store.articles.rows(before=number).select("article_id", "feed_id", "fetched_at", "url_hash", "content_hash", "short", "dedupe_of")
        inserted, hits = exact_dedup(df, known, days)
        rows = inserted.withColumns({"word_count": word_count(F.col("content_text")), "status": F.lit("pending"), "dedupe_of": F.lit(None).cast("long")})
        store.articles.write(rows, number)
        store.audit.write(hits, number)
        new = store.articles.rows(number=number)
        store.topics.write(match_keywords(new, topics), number)
        store.tasks.write(new.select("article_id", F.explode(F.array(*map(F.lit, NEW_TASKS))).alias("task"), F.lit("queued").alias("status")), number)
        write_article_index(new, f"{store.path}/index/batch={number}", segments_from=number << 48)

    return _start(items, checkpoint, each=batch, once=once)


def start_dedup(items: DataFrame, keys: Sequence[str], ts: str, row_id: str, kept: KeyedLog, checkpoint: str, days: int = 30, once: bool = True) -> StreamingQuery:
    """Rows whose key has not been kept within ``days`` before them, into ``kept``, whose schema holds ``keys``, ``ts`` and ``row_id``.

    The state is what was kept: of it only the rows young enough to bar one of the batch are read, so a key that comes
    back after ``days`` is kept again, whatever the other keys' times. Equal times go by ``row_id``; a row that comes late is
    barred by a kept row after it, too. Null keys are equal to each other.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = cut_lineage(df.select("*", F.unix_micros(ts).alias("t")))
        since = rows.agg(F.min(ts)).first()[0]
        if since is None:
            kept.write(df.limit(0), number)
            return
        held = kept.rows(before=number).where(F.col(ts) > F.lit(since) - F.make_dt_interval(F.lit(days)))
        held = held.select(*[F.col(k).alias(f"held_{k}") for k in keys], F.unix_micros(ts).alias("held_t"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"held_{k}")) for k in keys])
        rest = rows.join(held, same & (F.col("held_t") > F.col("t") - days * DAY), "left_anti")
        key = F.struct(*keys).alias("_key")
        won = chain_winners(rest.select(row_id, key, "t"), "_key", row_id, days * DAY).where(F.col(row_id) == F.col("winner_id"))
        kept.write(rest.join(won.select(row_id), row_id, "left_semi"), number)

    return _start(items, checkpoint, each=batch, once=once)


class PeriodCounts:
    """Counts per period and source as a log of batches, the rows that came too late, and the clock that tells them."""

    def __init__(self, spark: SparkSession, path: str):
        self.parts = KeyedLog(spark, f"{path}/counts", ["period_start", "source"], "period_start date, source string, n long")
        self.late = KeyedLog(spark, f"{path}/late", ["source"], "period_start date, source string, ts timestamp")
        self.clock = KeyedLog(spark, f"{path}/clock", ["seen"], "seen timestamp")

    def counts(self) -> DataFrame:
        """period_start, source, n: rows in time; n_late: rows that came after their period was closed."""
        rows = self.parts.rows().select("period_start", "source", "n", F.lit(0).cast("long").alias("n_late")).unionByName(
            self.late.rows().select("period_start", "source", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("n_late")))
        return rows.groupBy("period_start", "source").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def start_windows(items: DataFrame, source: str, ts: str, table: PeriodCounts, checkpoint: str, period: str = "daily",
                  delay: str = "2 days", once: bool = True) -> StreamingQuery:
    """Counts per source and day or Monday-based week.

    A period is closed once the latest time of the batches before is ``delay`` past its end; rows for it go to the table's
    late rows, where they are counted, too. Each batch logs its own counts, which readers add up. Null times are left out.
    """
    # epoch day 0 is a Thursday: weeks are shifted by four days to start on Monday
    width = F.window(ts, "1 day") if period == "daily" else F.window(ts, "7 days", "7 days", "4 days")

    def batch(df: DataFrame, number: int) -> None:
        seen = table.clock.rows(before=number).agg(F.max("seen")).first()[0]
        rows = df.where(F.col(ts).isNotNull()).select(F.col(source).alias("source"), F.col(ts).alias("ts"), width.alias("w"))
        rows = rows.select("source", "ts", F.col("w.start").cast("date").alias("period_start"), F.col("w.end").alias("end"))
        late = F.lit(False) if seen is None else F.col("end") <= F.lit(seen) - F.expr(f"INTERVAL {delay}")
        table.parts.write(rows.where(~late).groupBy("period_start", "source").agg(F.count("*").alias("n")), number)
        table.late.write(rows.where(late), number)
        table.clock.write(rows.agg(F.max("ts").alias("seen")).where("seen IS NOT NULL"), number)

    return _start(items, checkpoint, each=batch, once=once)


FAILURE_SCHEMA = "feed_id long, seq long, failures long, longest_run long, n_late long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailureRuns(StatefulProcessor):
    """Failure runs of a feed. Rows of the last ``delay`` before its latest one wait in order; older ones are folded into the run.

    A timer at a feed's latest row drops its state once the watermark, which lags by the time to live, has passed it. Rows
    that come behind what is folded already are counted as late.
    """

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "seq long, failures long, longest_run long, n_late long, closed long, latest long")
        self.waiting = handle.getListState("waiting", "seq long, t long, ok boolean")

    @staticmethod
    def fold(run: tuple, rows: list[tuple]) -> tuple:
        seq, failures, longest = run
        for at, _, ok in rows:
            failures = 0 if ok else failures + 1
            seq, longest = at, max(longest, failures)
        return seq, failures, longest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        none = (-1, 0, 0, 0, -(1 << 62), -(1 << 62))
        seq, failures, longest, late, closed, latest = self.run.get() if self.run.exists() else none
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            for at, t, ok in zip(part.seq.tolist(), part.t.tolist(), part.ok.tolist()):
                if t < closed:
                    late += 1
                else:
                    held.append((at, t, ok))
                    latest = max(latest, t)
        closed = max(closed, latest - self.delay_us)
        held.sort()
        n = next((i for i, r in enumerate(held) if r[1] >= closed), len(held))
        seq, failures, longest = self.fold((seq, failures, longest), held[:n])
        self.run.update((seq, failures, longest, late, closed, latest))
        if held[n:]:
            self.waiting.put(held[n:])
        else:
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest // 1000 + 1)
        seq, failures, longest = self.fold((seq, failures, longest), held[n:])  # as known so far
        yield pd.DataFrame({"feed_id": [key[0]], "seq": [seq], "failures": [failures], "longest_run": [longest], "n_late": [late]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        self.waiting.clear()
        yield pd.DataFrame({"feed_id": [], "seq": [], "failures": [], "longest_run": [], "n_late": []})

    def close(self) -> None:
        pass


def start_failures(fetches: DataFrame, table: KeyedLog, checkpoint: str, delay_days: float = 2, ttl_days: float = 90, once: bool = True) -> StreamingQuery:
    """Consecutive failures per feed of ``fetches`` (feed_id, seq, ts, ok), kept in keyed state; each change is logged in ``table``.

    ``seq`` orders a feed's fetches and grows with ``ts``. Rows may come up to ``delay_days`` behind their feed's latest, in
    any order. A feed without rows for ``ttl_days`` of event time begins anew; rows older than that are dropped.
    """
    spark = fetches.sparkSession
    spark.conf.set(STORE, ROCKS)  # keyed state with several variables needs it
    rows = fetches.select("feed_id", "seq", "ts", F.unix_micros("ts").alias("t"), "ok").dropna()
    runs = rows.withWatermark("ts", f"{int(ttl_days * 24)} hours").groupBy("feed_id").transformWithStateInPandas(
        FailureRuns(int(delay_days * DAY)), FAILURE_SCHEMA, "Update", "EventTime")
    return _start(runs, checkpoint, mode="update", each=lambda df, number: table.write(df, number), once=once)


def start_upsert(changes: DataFrame, table: KeyedLog, order: Sequence[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Latest-wins table: the last change per key of each batch is logged."""
    return _start(changes, checkpoint, each=lambda df, number: table.write(latest_per_key(df, table.keys, list(order)), number), once=once)
