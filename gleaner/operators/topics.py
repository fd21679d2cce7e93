"""Topic tagging, aggregation and registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import top_per_group
from .search import LITERAL_NEEDLES, contains_any
from .tables import cascade, upsert_latest


def match_keywords(articles: DataFrame, topics: DataFrame, limit: int = LITERAL_NEEDLES) -> DataFrame:
    """``(article_id, topic_id, score, method)`` for every enabled topic with a keyword hit.

    A keyword counts 1 in the text and 2 in the title; ``min(1, 0.2 * hits + 0.1 * title hits)``, so a title
    hit adds 0.3 to the 0.2 of a hit. Every token is a substring of the text: one test covers both.
    """
    words = topics.where("enabled").select("topic_id", F.explode("keywords").alias("kw")).select(
        "topic_id", F.lower(F.trim("kw")).alias("kw")).where("kw <> ''")
    hay = articles.select("article_id", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(
        F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content_text", F.lit("")))).alias("hay"))
    hits = contains_any(hay, "article_id", "hay", words, "topic_id", "kw", limit, keep=("t",))
    titled = F.contains("t", F.col("kw")).cast("int")
    return (
        hits.select("article_id", "topic_id", titled.alias("title"))
        .groupBy("article_id", "topic_id")
        .agg(F.round(F.least(F.lit(1.0), F.count("*") * 0.2 + F.sum("title") * 0.3), 6).alias("score"))
        .withColumn("method", F.lit("keyword"))
    )


def score_topics(articles: DataFrame, scores: DataFrame, article_topics: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows to add for articles without a keyword topic from a table of scores; existing rows win."""
    tagged = article_topics.where("method = 'keyword'").select("article_id").distinct()
    open_ = articles.select("article_id").join(tagged, "article_id", "left_anti")
    return (
        scores.where(F.col("score") >= threshold).join(open_, "article_id", "left_semi")
        .join(article_topics.select("article_id", "topic_id"), ["article_id", "topic_id"], "left_anti")
        .select("article_id", "topic_id", "score", F.lit("llm").alias("method"))
    )


def topic_articles(articles: DataFrame, article_topics: DataFrame, n: int = 20) -> DataFrame:
    """Best ``n`` live articles of every topic, by score then recency."""
    live = articles.where(F.col("dedupe_of").isNull())
    order = [F.col("score").desc(), F.col("published_at").desc(), F.col("article_id")]
    return top_per_group(article_topics.join(live, "article_id"), ["topic_id"], order, n)


def reclassify(articles: DataFrame, article_topics: DataFrame, topics: DataFrame, topic_id: int, now, days: int = 30
               ) -> tuple[DataFrame, DataFrame]:
    """Keyword rows of a changed topic recomputed inside the window; everything older is kept.

    Also returns the live articles of the window that no keyword covers and that need scoring.
    """
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    inside = articles.where(F.col("fetched_at") > since)
    live = inside.where(F.col("dedupe_of").isNull())
    stale = article_topics.where((F.col("topic_id") == topic_id) & (F.col("method") == "keyword")).join(
        inside.select("article_id"), "article_id", "left_semi")
    keep = article_topics.join(stale.select("article_id", "topic_id"), ["article_id", "topic_id"], "left_anti")
    fresh = match_keywords(live, topics)
    out = upsert_latest(keep, fresh, ["article_id", "topic_id"])
    uncovered = live.join(fresh.select("article_id"), "article_id", "left_anti").select("article_id", "content_hash")
    return out, uncovered


def upsert_topics(topics: DataFrame, changes: DataFrame) -> DataFrame:
    """Create or update topics by id; a name held by another topic is refused."""
    out = upsert_latest(topics, changes, ["topic_id"])
    clash = out.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    bad = changes.join(clash, "name", "left_semi").select("topic_id")
    return upsert_latest(topics, changes.join(bad, "topic_id", "left_anti"), ["topic_id"])


def delete_topics(topics: DataFrame, article_topics: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = topics.join(ids.select("topic_id"), "topic_id", "left_anti")
    return kept, cascade(article_topics, kept, "topic_id")
