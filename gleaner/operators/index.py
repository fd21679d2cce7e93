"""Term index of articles and wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens
from .postings import PostingIndex, write_index


def index_text(df: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """``(doc_id, dl, terms map<term, tf>, token_text)``, one row per row of ``df``, which has each document once.

    Terms are counted inside the row, as lengths of the runs of its sorted tokens: nothing is shuffled and a task holds
    one document at a time.
    """
    toks = df.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("toks")).withColumn("sorted", F.sort_array("toks"))
    fresh = lambda t, i: F.when((i == 0) | (t != F.get("sorted", i - 1)), i)
    starts = toks.withColumn("starts", F.array_compact(F.transform("sorted", fresh)))
    tf = F.transform("starts", lambda at, i: F.coalesce(F.get("starts", i + 1), F.size("sorted")) - at)
    return starts.select(
        "doc_id", F.size("toks").cast("long").alias("dl"),
        F.map_from_arrays(F.transform("starts", lambda at: F.get("sorted", at)), tf).alias("terms"),
        F.array_join("toks", " ").alias("token_text"))


def _article_texts(articles: DataFrame, summaries: DataFrame | None, only_missing: DataFrame | None) -> tuple[DataFrame, Column]:
    src = articles
    if only_missing is not None:
        src = src.join(only_missing.select(F.col("doc_id").alias("article_id")), "article_id", "left_anti")
    parts = [F.col("title"), F.col("content_text")]
    if summaries is not None:
        src = src.join(summaries.select("article_id", "summary_text", "key_points"), "article_id", "left")
        parts += [F.col("summary_text"), F.array_join("key_points", " ")]
    return src, F.concat_ws(" ", *parts)


def build_index(articles: DataFrame, summaries: DataFrame | None = None, only_missing: DataFrame | None = None) -> DataFrame:
    """Index of title, text and, where present, summary and key points.

    ``only_missing`` is an existing index: documents it holds are left out.
    """
    src, text = _article_texts(articles, summaries, only_missing)
    return index_text(src, "article_id", text)


def write_article_index(articles: DataFrame, path: str, summaries: DataFrame | None = None, only_missing: DataFrame | None = None,
                        segments_from: int = 0) -> PostingIndex:
    """The same texts as posting lists stored below ``path``, for keyword search."""
    src, text = _article_texts(articles, summaries, only_missing)
    write_index(src, "article_id", text, path, segments_from=segments_from)
    return PostingIndex(articles.sparkSession, path)


def write_wiki_index(pages: DataFrame, path: str) -> PostingIndex:
    write_index(pages, "page_id", F.concat_ws(" ", "title", "content_md"), path)
    return PostingIndex(pages.sparkSession, path)


def build_wiki_index(pages: DataFrame) -> DataFrame:
    return index_text(pages, "page_id", F.concat_ws(" ", "title", "content_md"))


def postings(index: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)``."""
    return index.select("doc_id", "dl", F.explode("terms").alias("term", "tf"))
