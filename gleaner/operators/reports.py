"""Period statistics and report tables, all periods in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import top_per_group

UNIT = {"daily": "day", "weekly": "week"}  # weeks start on Monday


def stats_total(articles: DataFrame, start, end) -> DataFrame:
    """Live articles in [start, end]."""
    inside = F.col("fetched_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return articles.where(inside & F.col("dedupe_of").isNull()).agg(F.count("*").alias("articles_total"))


def stats_by_source(articles: DataFrame, feeds: DataFrame, start, end, n: int = 5) -> DataFrame:
    inside = F.col("fetched_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    counted = articles.where(inside & F.col("dedupe_of").isNull()).groupBy("feed_id").agg(F.count("*").alias("n_articles"))
    return counted.join(feeds.select("feed_id", "name"), "feed_id").orderBy(F.col("n_articles").desc(), "name").limit(n).select("name", "n_articles")


def reports(articles: DataFrame, feeds: DataFrame, attempts: DataFrame, summaries: DataFrame, period: str = "daily",
            n_sources: int = 5) -> DataFrame:
    """One row per period: totals, top sources, attempts by outcome, summaries, and the markdown text."""
    unit = UNIT[period]
    start = lambda ts: F.date_trunc(unit, ts).cast("date")
    live = articles.where(F.col("dedupe_of").isNull()).select("article_id", "feed_id", start("fetched_at").alias("period_start"))
    # feeds are few per period after this partial aggregate; everything below works on its output
    per_feed = live.join(summaries.select("article_id", F.lit(1).alias("s")), "article_id", "left").groupBy(
        "period_start", "feed_id").agg(F.count("*").alias("n"), F.count("s").alias("s"))
    totals = per_feed.groupBy("period_start").agg(F.sum("n").alias("articles_total"), F.sum("s").alias("summaries_generated"))
    named = per_feed.join(feeds.select("feed_id", "name"), "feed_id")
    tops = top_per_group(named, ["period_start"], [F.col("n").desc(), F.col("name")], n_sources).groupBy("period_start").agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "n"))).alias("r")).select(
        "period_start", F.array_join(F.transform("r", lambda e: F.concat_ws(":", e["name"], e["n"])), ", ").alias("articles_by_source"))
    queue = attempts.groupBy(start("ts").alias("period_start"), "outcome").agg(F.count("*").alias("n")).groupBy("period_start").agg(
        F.sort_array(F.collect_list(F.struct("outcome", "n"))).alias("q")).select(
        "period_start", F.array_join(F.transform("q", lambda e: F.concat_ws(":", e["outcome"], e["n"])), ", ").alias("queue_stats"))
    days = 1 if period == "daily" else 7
    joined = totals.join(tops, "period_start", "left").join(queue, "period_start", "left")
    first, last = F.col("period_start").cast("string"), F.date_add("period_start", days - 1).cast("string")
    heading = F.concat(F.lit("# "), first) if period == "daily" else F.concat(F.lit("# "), first, F.lit(" - "), last)
    return joined.select(
        F.lit(period).alias("report_type"), "period_start", F.date_add("period_start", days - 1).alias("period_end"),
        "articles_total", "summaries_generated", F.coalesce("articles_by_source", F.lit("")).alias("articles_by_source"),
        F.coalesce("queue_stats", F.lit("")).alias("queue_stats"),
        F.concat(heading, F.lit("\n\n- articles: "), "articles_total", F.lit("\n- sources: "),
                 F.coalesce("articles_by_source", F.lit("")), F.lit("\n- queue: "), F.coalesce("queue_stats", F.lit("")), F.lit("\n")).alias("content_md"))


def growth(articles: DataFrame, article_topics: DataFrame, topics: DataFrame, entities: DataFrame, relations: DataFrame,
           top: int = 20) -> DataFrame:
    """Weekly growth as ``(week, measure, name, n, previous)``: top topics with the week before, new entities and relations.

    What was there the week before and is gone has a row with n = 0, up to the latest week with an article.
    """
    week = lambda ts: F.date_trunc("week", ts).cast("date")
    live = articles.where(F.col("dedupe_of").isNull()).select("article_id", week("fetched_at").alias("week"))
    counted = article_topics.join(live, "article_id").groupBy("week", "topic_id").agg(F.count("*").alias("n"))
    prev = counted.select(F.date_add("week", 7).alias("week"), "topic_id", F.col("n").alias("previous"))
    last = live.agg(F.max("week").alias("last_week"))  # one row

    def both(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
        met = now.join(before, keys, "full_outer").join(F.broadcast(last), F.col("week") <= F.col("last_week")).drop("last_week")
        zero = F.lit(0).cast("long")
        return met.withColumns({"n": F.coalesce("n", zero), "previous": F.coalesce("previous", zero)})

    moved = both(counted, prev, ["week", "topic_id"]).join(topics.select("topic_id", "name"), "topic_id")
    best = top_per_group(moved, ["week"], [F.col("n").desc(), F.col("topic_id")], top).select(
        "week", F.lit("topic").alias("measure"), "name", "n", "previous")

    def fresh(df: DataFrame, label: str) -> DataFrame:
        n = df.groupBy(week("first_seen").alias("week")).agg(F.count("*").alias("n"))
        before = n.select(F.date_add("week", 7).alias("week"), F.col("n").alias("previous"))
        return both(n, before, ["week"]).select("week", F.lit(label).alias("measure"), F.lit("").alias("name"), "n", "previous")

    return best.unionByName(fresh(entities, "entities_new")).unionByName(fresh(relations, "relations_new"))


def list_reports(df: DataFrame, report_type: str | None = None, n: int = 30) -> DataFrame:
    out = df if report_type is None else df.where(F.col("report_type") == report_type)
    return out.orderBy(F.col("period_start").desc(), "report_type").limit(n)
