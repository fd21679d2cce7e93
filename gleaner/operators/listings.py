"""Listings and dashboard numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .postings import PostingIndex
from .ranking import latest_per_key, top_per_group


def list_articles(articles: DataFrame, feeds: DataFrame | None = None, article_topics: DataFrame | None = None,
                  topics: DataFrame | None = None, index: PostingIndex | None = None, feed: str | int | None = None,
                  topic: str | None = None, status: str | None = None, q: str | None = None, page: int = 1,
                  size: int = 20) -> DataFrame:
    """One page of live articles, newest first; ``q`` is looked up in the index, without one as part of title or text."""
    out = articles.where(F.col("dedupe_of").isNull())
    if feed is not None:
        if str(feed).isdigit():
            out = out.where(F.col("feed_id") == int(feed))
        else:
            out = out.join(feeds.where(F.col("name") == feed).select("feed_id"), "feed_id", "left_semi")
    if status is not None:
        out = out.where(F.col("status") == status)
    if topic is not None:
        named = topics.where(F.col("name") == topic).select("topic_id")
        out = out.join(article_topics.join(named, "topic_id", "left_semi").select("article_id"), "article_id", "left_semi")
    if q and q.strip():
        from .search import keyword_matches

        asked = articles.sparkSession.createDataFrame([(0, q)], "query_id long, query string")
        # every match may be on some page: they are neither ranked nor cut
        if index is None:
            out = substring_filter(out, q)
        else:
            out = out.join(keyword_matches(index, asked).select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    cols = ["article_id", "title", "status", "lang", "published_at", "feed_id", "fetched_at"]
    return out.select(*cols).orderBy(F.col("fetched_at").desc(), "article_id").offset((page - 1) * size).limit(size)


def details(articles: DataFrame, summaries: DataFrame, translations: DataFrame, entities: DataFrame,
            article_entities: DataFrame, topics: DataFrame, article_topics: DataFrame, pages: DataFrame,
            n_entities: int = 20) -> DataFrame:
    """Every article with its summary, latest translation, surest entities, topics and page."""
    latest = latest_per_key(translations.select("article_id", "seq", "translated_title", "translated_content"), ["article_id"], ["seq"])
    ents = top_per_group(
        article_entities.select("article_id", "entity_id", "confidence").join(entities.select("entity_id", "name", "type"), "entity_id"),
        ["article_id"], [F.col("confidence").desc(), F.col("entity_id")], n_entities
    ).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "type", "confidence"))).alias("entities"))
    tops = article_topics.join(topics.select("topic_id", F.col("name").alias("topic")), "topic_id").groupBy("article_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg_score"), "topic", "method"))).alias("topics"))
    page = pages.where("kind = 'article'").select(F.col("ref_id").alias("article_id"), "slug")
    return (
        articles.join(summaries.select("article_id", "summary_text", "key_points"), "article_id", "left")
        .join(latest.drop("seq"), "article_id", "left").join(ents, "article_id", "left")
        .join(tops, "article_id", "left").join(page, "article_id", "left")
    )


def translation_state(articles: DataFrame, translations: DataFrame, states: DataFrame) -> DataFrame:
    """``translated`` / ``translating`` / ``none`` per article; ``states`` are the current task states."""
    done = latest_per_key(translations.select("article_id", "seq", "translated_content"), ["article_id"], ["seq"]).where(
        "translated_content <> ''").select("article_id", F.lit(True).alias("done"))
    busy = states.where("task = 'translate' and status in ('queued', 'running')").select("article_id", F.lit(True).alias("busy")).distinct()
    return articles.select("article_id").join(done, "article_id", "left").join(busy, "article_id", "left").select(
        "article_id", F.when(F.col("done"), "translated").when(F.col("busy"), "translating").otherwise("none").alias("state"))


def corpus_counts(articles: DataFrame, now) -> DataFrame:
    """Totals in one pass."""
    live = F.col("dedupe_of").isNull()
    recent = F.col("fetched_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(1))
    return articles.agg(
        F.count_if(live).alias("total"), F.count_if(live & recent).alias("last_day"),
        F.count_if(F.col("status") == "pending").alias("pending"))


def recent_articles(articles: DataFrame, n: int = 20) -> DataFrame:
    cols = ["article_id", "title", "status", "lang", "published_at", "fetched_at"]
    return articles.where(F.col("dedupe_of").isNull()).select(*cols).orderBy(F.col("fetched_at").desc(), "article_id").limit(n)


def feed_health(feeds: DataFrame, n: int = 10) -> DataFrame:
    return feeds.orderBy(F.col("fetch_failures").desc(), "feed_id").limit(n)


def queue_stats(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def substring_filter(articles: DataFrame, q: str) -> DataFrame:
    """Plain substring fallback of the listing on title or text."""
    needle = F.lit(q.strip().lower())
    return articles.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("content_text"), needle))
