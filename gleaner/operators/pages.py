"""Wiki pages for articles, entities and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slugify
from .ranking import top_per_group

# The low two bits of a page id tell the kind, headings and labels of the page text.
KIND_CODE = {"article": 0, "entity": 1, "topic": 2, "manual": 3}
KEY_POINTS, RELATED, SOURCE = "## 要点\n", "## 相关文章\n", "原文: "


def page_id(kind: str, ref_id: Column) -> Column:
    return ref_id * 4 + KIND_CODE[kind]


def _page(df: DataFrame, kind: str, ref: str, parts: list[Column]) -> DataFrame:
    ref_id = F.col(ref)
    return df.select(
        page_id(kind, ref_id).alias("page_id"), F.lit(kind).alias("kind"), ref_id.alias("ref_id"), "title",
        slugify(F.col("title"), ref_id, kind).alias("slug"), F.concat_ws("\n", *parts).alias("content_md"), "related")


def _optional(present: Column, *lines: Column) -> list[Column]:
    """Lines that appear only when ``present``; ``concat_ws`` skips nulls."""
    return [F.when(present, line) for line in lines]


def article_pages(articles: DataFrame, summaries: DataFrame, related: DataFrame) -> DataFrame:
    """Page per titled article: summary, key points, source link and its related articles."""
    titles = articles.select(F.col("article_id").alias("related_id"), F.col("title").alias("related_title"))
    lists = (
        related.join(titles, "related_id").groupBy("article_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("related_id").alias("id"), F.col("related_title").alias("title"), "src", "score"))).alias("r"))
        .select("article_id", F.transform("r", lambda e: e.dropFields("rank")).alias("related"))
    )
    rows = (
        articles.where(F.col("title") != "").join(summaries.select("article_id", "summary_text", "key_points"), "article_id", "left")
        .join(lists, "article_id", "left")
    )
    points = F.coalesce("key_points", F.array().cast("array<string>"))
    parts = [
        F.concat(F.lit("# "), "title", F.lit("\n")),
        *_optional(F.coalesce("summary_text", F.lit("")) != "", F.concat("summary_text", F.lit("\n"))),
        *_optional(F.size(points) > 0, F.lit(KEY_POINTS),
                   F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("")),
        *_optional(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit(SOURCE), "source_url")),
    ]
    return _page(rows, "article", "article_id", parts)


def _listed(df: DataFrame, kind: str, ref: str, hits: DataFrame) -> DataFrame:
    """Page with a description and a list of linked articles; ``hits`` has ref, article fields and rank."""
    line = F.concat(F.lit("- ["), F.coalesce("title", F.col("article_id").cast("string")), F.lit("]("),
                    F.coalesce("source_url", F.lit("#")), F.lit(")"))
    lists = hits.groupBy(ref).agg(F.sort_array(F.collect_list(F.struct(
        "rank", line.alias("line"), F.col("article_id").alias("id"), F.col("title").alias("title"), F.lit(kind).alias("src"),
        F.lit(0.0).alias("score")))).alias("r"))
    rows = df.join(lists, ref, "left").withColumn("related", F.transform("r", lambda e: e.dropFields("rank", "line")))
    any_ = F.size(F.coalesce("related", F.array())) > 0
    parts = [
        F.concat(F.lit("# "), "title", F.lit("\n")),
        *_optional(F.coalesce("description", F.lit("")) != "", F.concat("description", F.lit("\n"))),
        *_optional(any_, F.lit(RELATED), F.array_join(F.transform("r", lambda e: e["line"]), "\n"), F.lit("")),
    ]
    return _page(rows.where(F.col("title") != ""), kind, ref, parts)


def entity_pages(entities: DataFrame, articles: DataFrame, article_entities: DataFrame, n: int = 10) -> DataFrame:
    live = articles.where(F.col("dedupe_of").isNull()).select("article_id", "title", "source_url", "published_at")
    hits = top_per_group(article_entities.select("article_id", "entity_id").join(live, "article_id"), ["entity_id"],
                         [F.col("published_at").desc(), F.col("article_id")], n)
    return _listed(entities.select("entity_id", F.col("name").alias("title"), "description"), "entity", "entity_id", hits)


def topic_pages(topics: DataFrame, articles: DataFrame, article_topics: DataFrame, n: int = 10) -> DataFrame:
    from .topics import topic_articles

    hits = topic_articles(articles.select("article_id", "title", "source_url", "published_at", "dedupe_of"), article_topics, n)
    return _listed(topics.select("topic_id", F.col("name").alias("title"), "description"), "topic", "topic_id", hits)


def pages(df: DataFrame, slug: str | None = None, kind: str | None = None, q: str | None = None, n: int = 50,
          recent: str = "updated_at") -> DataFrame:
    """One page by slug, or the ``n`` most recent of a kind whose title or text contains ``q``."""
    if slug is not None:
        return df.where(F.col("slug") == slug)
    out = df if kind is None else df.where(F.col("kind") == kind)
    if q:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "title", "content_md")), F.lit(q.lower())))
    return out.orderBy(F.col(recent).desc(), "page_id").limit(n)
