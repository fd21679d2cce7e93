"""Analytics over attempt logs: current task state, failure streaks, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ACTIVE = ["queued", "running"]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
            sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and maxima per key in two levels.

    ``chunk`` must not decrease along ``order``. Rows are scanned per (key, chunk); the totals of the chunks,
    few per key, are scanned per key and added back. So one key may hold most of the log: its rows are still
    spread over its chunks. Chunks must not be null.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = df.withColumn("_chunk", chunk)
    for name, col in {**sums, **maxima}.items():
        rows = rows.withColumn(f"_{name}", col)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_{n}").alias(n) for n in sums], *[F.max(f"_{n}").alias(n) for n in maxima])
    carried = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in sums],
                            *[F.max(n).over(before).alias(f"_in_{n}") for n in maxima])
    out = rows.join(carried, [*keys, "_chunk"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_in_{n}") + F.sum(f"_{n}").over(inner))
    for n in maxima:
        out = out.withColumn(n, F.greatest(F.col(f"_in_{n}"), F.max(f"_{n}").over(inner)))
    return out.select(*df.columns, *sums, *maxima)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, hit: Column, name: str = "streak") -> DataFrame:
    """Length of the run of ``hit`` rows ending at each row (0 where the row is no hit)."""
    flagged = df.withColumn("_hit", hit.cast("long"))
    summed = running(flagged, keys, order, chunk, sums={"_sum": F.col("_hit")})
    based = running(summed, keys, order, chunk, maxima={"_base": F.when(F.col("_hit") == 0, F.col("_sum"))})
    return based.withColumn(name, F.col("_sum") - F.coalesce("_base", F.lit(0))).drop("_hit", "_sum", "_base")


CHUNK = 4_096  # values of the order column


def chunk_of(order: str = "seq") -> Column:
    """Ranges of the order column itself: they follow the order whatever the timestamps say. Null orders come first."""
    return F.coalesce(F.floor(F.col(order) / CHUNK), F.lit(-(1 << 62)))


def feed_state(fetch_log: DataFrame, after: int = 5) -> DataFrame:
    """Feed health from the fetch log ``(feed_id, seq, ts, ok)``.

    Current failures since the last success, the longest run, when a run first reached ``after``, and the
    state: disabled / degraded / healthy.
    """
    runs = streaks(fetch_log, ["feed_id"], ["seq"], chunk_of(), ~F.col("ok"))
    out = runs.groupBy("feed_id").agg(
        F.max_by("streak", "seq").alias("fetch_failures"), F.max("streak").alias("longest_run"),
        F.min(F.when(F.col("streak") >= after, F.col("seq"))).alias("disabled_at_seq"))
    return out.withColumn("state", F.when(F.col("fetch_failures") >= after, "disabled").when(
        F.col("fetch_failures") > 0, "degraded").otherwise("healthy"))


def current_state(attempts: DataFrame) -> DataFrame:
    """Latest row per (article, task): a partial aggregate, so hot articles cost one row per map task."""
    return attempts.groupBy("article_id", "task").agg(F.max_by(F.struct("seq", "ts", "outcome"), "seq").alias("w")).select(
        "article_id", "task", "w.seq", "w.ts", "w.outcome", status_of(F.col("w.outcome")).alias("status"))


def status_of(outcome: Column) -> Column:
    return F.when(outcome == "succeeded", "succeeded").when(outcome.isin("superseded", "failed"), outcome).otherwise("queued")


def superseded(attempts: DataFrame) -> DataFrame:
    """Enqueued rows overtaken by a later enqueue of the same (article, task)."""
    queued = attempts.where("outcome = 'queued'")
    newest = queued.groupBy("article_id", "task").agg(F.max("seq").alias("newest"))
    return queued.join(newest, ["article_id", "task"]).where("seq < newest").drop("newest")


def outcomes(attempts: DataFrame, max_attempts: int = 3, max_timeouts: int = 3) -> DataFrame:
    """Verdict per attempt for ``(article_id, task, seq, ts, outcome)``.

    An enqueue starts a new job. Within a job permanent failures spend the budget, other failures reset the
    run of timeouts, and the job is dead when either limit is reached; rows after that are ``ignored``.
    """
    keys, order = ["article_id", "task"], ["seq"]
    kind = F.col("outcome")
    jobs = running(attempts, keys, order, chunk_of(), sums={"job": F.when(kind == "queued", 1).otherwise(0)})
    per_job = [*keys, "job"]
    spent = running(jobs, per_job, order, chunk_of(), sums={"spent": F.when(kind == "permanent", 1).otherwise(0)})
    timed = streaks(spent, per_job, order, chunk_of(), kind == "timeout", "timeouts")
    dead = (F.col("spent") >= max_attempts) | (F.col("timeouts") >= max_timeouts)
    died = timed.groupBy(*per_job).agg(F.min(F.when(dead, F.col("seq"))).alias("died_at"))
    return timed.join(died, per_job).select(
        *keys, "job", "seq", "outcome", "spent", "timeouts",
        F.when(F.col("seq") > F.col("died_at"), "ignored").when(F.col("seq") == F.col("died_at"), "dead")
        .when(kind.isin("timeout", "transient", "permanent"), "retry").otherwise(kind).alias("verdict"))


def merge_payloads(batches: DataFrame) -> DataFrame:
    """Distinct ids over an article's active batches ``(article_id, task, ids)``; distinct before collecting."""
    return (
        batches.select("article_id", "task", F.explode("ids").alias("id")).distinct()
        .groupBy("article_id", "task").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )


def finished(articles: DataFrame, states: DataFrame) -> DataFrame:
    """Processing live articles without an active task other than translate."""
    busy = states.where(F.col("status").isin(ACTIVE) & (F.col("task") != "translate")).select("article_id")
    return articles.where("status = 'processing' and dedupe_of is null").join(busy, "article_id", "left_anti")


def unstarted(articles: DataFrame, states: DataFrame, tasks: Sequence[str] = ("embed_core", "summarize")) -> DataFrame:
    """Tasks to start for pending live articles that never had one."""
    fresh = articles.where("status = 'pending' and dedupe_of is null").join(states.select("article_id"), "article_id", "left_anti")
    return fresh.select("article_id", "content_hash", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))


def prune(states: DataFrame, now) -> DataFrame:
    """Superseded rows go after an hour, succeeded ones after a day."""
    at = F.lit(now).cast("timestamp")
    old = ((F.col("status") == "superseded") & (F.col("ts") < at - F.make_dt_interval(hours=F.lit(1)))) | (
        (F.col("status") == "succeeded") & (F.col("ts") < at - F.make_dt_interval(hours=F.lit(24))))
    return states.where(~old)
