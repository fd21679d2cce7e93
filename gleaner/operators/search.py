"""Keyword and hybrid search: a table of queries against the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..session import cut_lineage, small_side
from .postings import PostingIndex
from .ranking import reciprocal_rank_fusion, top_per_group

# The usual BM25 parameters.
K1, B = 1.2, 0.75
FIRST_SEGMENTS = 8  # segments of a query that are looked at before the bounds of the others


def query_alternatives(queries: DataFrame) -> DataFrame:
    """``(query_id, alt, pos, phrases, neg)`` from web-search text.

    Blank-separated items must all match; ``"..."`` is a phrase, ``-item`` must not occur, ``or`` starts
    another alternative.
    """
    items = F.regexp_extract_all(F.lower("query"), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    each = (
        queries.select("query_id", items.alias("items"))
        .select("query_id", "items", F.posexplode("items").alias("pos_no", "item"))
        .where(F.col("item") != "or")
        .select("query_id", "pos_no",
                F.size(F.filter(F.slice("items", 1, F.col("pos_no") + 1), lambda x: x == "or")).alias("alt"),
                F.col("item").startswith("-").alias("no"), F.col("item").contains('"').alias("quoted"),
                tokens(F.col("item")).alias("toks"))
        .where(F.size("toks") > 0)
    )
    joined = F.array_join("toks", " ")
    yes = ~F.col("no")
    return (
        each.groupBy("query_id", "alt").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(yes, F.col("toks")))))).alias("pos"),
            F.collect_list(F.when(yes & F.col("quoted") & (F.size("toks") > 1), joined)).alias("phrases"),
            F.collect_list(F.when(~yes, joined)).alias("neg"))
    )


def _units(alts: DataFrame) -> DataFrame:
    """query_id, alt, unit, phrases, terms: the positive part of an alternative is unit -1, its exclusions are 0, 1, ...

    A document matches a unit if it holds all terms, and the words of every phrase one after the other."""
    none = F.array().cast("array<array<string>>")
    split = lambda p: F.split(p, " ")
    yes = alts.where(F.size("pos") > 0).select("query_id", "alt", F.lit(-1).alias("unit"), F.transform("phrases", split).alias("phrases"), F.col("pos").alias("terms"))
    no = alts.select("query_id", "alt", F.posexplode("neg").alias("unit", "item")).withColumn("words", split(F.col("item")))
    return yes.unionByName(no.select("query_id", "alt", "unit", F.when(F.size("words") > 1, F.array("words")).otherwise(none).alias("phrases"), F.array_distinct("words").alias("terms")))


def _tf_part(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _evaluated(cells: DataFrame, asked: DataFrame, lists: DataFrame, avgdl: float) -> DataFrame:
    """query_id, alt, unit, segment, doc_id, s: documents of the ``cells`` (query_id, alt, unit, segment) that match their unit."""
    key = ["query_id", "alt", "unit"]
    rows = cells.select(*key, "segment").join(asked, key).join(lists, ["term", "segment"])
    spoken = F.size("phrases") > 0
    own = F.transform(F.arrays_zip("ends", "tfs"), lambda p: F.slice("places", p["ends"] - p["tfs"] + 1, p["tfs"]))
    zipped = F.arrays_zip("docs", "tfs", "dls", F.when(spoken, own).otherwise(F.array()).alias("places"))
    spots = rows.select(*key, "segment", "need", "phrases", "term", "idf", F.explode(zipped).alias("p"))
    held = spots.groupBy(*key, "segment", F.col("p.docs").alias("doc_id")).agg(
        F.count("*").alias("n"), F.first("need").alias("need"), F.first("phrases").alias("phrases"),
        F.sum(F.col("idf") * _tf_part(F.col("p.tfs"), F.col("p.dls"), avgdl)).alias("s"),
        F.collect_list(F.when(spoken, F.struct("term", "p.places"))).alias("spots"))
    at = F.map_from_entries("spots")

    def stands(words: Column) -> Column:
        follows = lambda p: F.forall(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_contains(at[F.get(words, i)], (p + i).cast("int")))
        return F.exists(at[F.get(words, F.lit(0))], follows)

    return held.where("n = need").where(F.forall("phrases", stands)).select(*key, "segment", "doc_id", "s")


def _unbarred(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.join(negative, ["query_id", "alt", "doc_id"], "left_anti")


def keyword_matches(index: PostingIndex, queries: DataFrame, k: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: matches with their BM25 score, in no order; with ``k``, at least the best k of each query.

    Only the buckets of asked terms are read. A segment is looked at if it has lists of all terms of an alternative; with
    ``k``, only if the bound of its scores is not below the k-th best of the segments with the highest bounds. An
    alternative of exclusions alone matches all other documents with score 0; with ``k``, the first k of every segment.
    """
    alts = cut_lineage(query_alternatives(queries))
    units = _units(alts)
    key = ["query_id", "alt", "unit"]
    terms = units.select(*key, "phrases", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    docs = index.docs()
    n_segments, n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.size("docs")), F.lit(0)), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    avgdl = total / n if n else 1.0
    lists = cut_lineage(index.lists(terms.select("term").distinct()))
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = cut_lineage(terms.join(df, "term").withColumn("idf", idf).drop("df"))
    heads = lists.select("term", "segment", (_tf_part(F.col("max_tf"), F.col("min_dl"), avgdl)).alias("most"))
    cells = asked.join(heads, "term").groupBy(*key, "segment").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.sum(F.col("idf") * F.col("most")).alias("bound"))
    cells = cut_lineage(cells.where("n = need").select(*key, "segment", "bound"))
    yes, no = cells.where("unit = -1"), cells.where("unit >= 0")
    barred = cut_lineage(_evaluated(no, asked, lists, avgdl).select("query_id", "alt", "segment", "doc_id").distinct())
    bars = barred.drop("segment")
    if k is None or n_segments <= FIRST_SEGMENTS:
        found = _unbarred(_evaluated(yes, asked, lists, avgdl), bars)
    else:
        ranked = cut_lineage(top_per_group(yes.groupBy("query_id", "segment").agg(F.max("bound").alias("bound")), ["query_id"], [F.col("bound").desc(), F.col("segment")], FIRST_SEGMENTS))
        first = cut_lineage(_unbarred(_evaluated(yes.join(ranked.select("query_id", "segment"), ["query_id", "segment"], "left_semi"), asked, lists, avgdl), bars))
        best = first.groupBy("query_id", "doc_id").agg(F.round(F.max("s"), 6).alias("s"))
        floor = top_per_group(best, ["query_id"], [F.col("s").desc(), F.col("doc_id")], k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("s")).alias("floor"))
        later = yes.join(ranked.select("query_id", "segment"), ["query_id", "segment"], "left_anti").join(floor, "query_id", "left")
        later = later.where("floor IS NULL OR bound >= floor - 1e-6")
        found = first.unionByName(_unbarred(_evaluated(later, asked, lists, avgdl), bars))
    found = found.select("query_id", "doc_id", "s")
    only = alts.where("size(pos) = 0").select("query_id", "alt")
    gone = barred.join(only, ["query_id", "alt"], "left_semi").groupBy("query_id", "alt", "segment").agg(F.collect_list("doc_id").alias("gone"))
    # the queries without a positive term are asked of every segment
    each = only.withColumn("every", F.lit(1)).join(docs.select("segment", "docs", F.lit(1).alias("every")), "every").join(gone, ["query_id", "alt", "segment"], "left")
    out = F.coalesce("gone", F.array().cast("array<long>"))
    first_docs = F.col("docs") if k is None else F.slice("docs", F.lit(1), F.lit(k) + F.size(out))
    rest = each.select("query_id", F.explode(F.array_except(first_docs, out)).alias("doc_id"), F.lit(0.0).alias("s"))
    return found.unionByName(rest).groupBy("query_id", "doc_id").agg(F.round(F.max("s"), 6).alias("score"))


def keyword_search(index: PostingIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best ``k`` matches per query."""
    return top_per_group(keyword_matches(index, queries, k), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def keyword_search_wiki(index: PostingIndex, pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Keyword search over wiki pages with the page fields attached, in rank order."""
    return keyword_search(index, queries, k).withColumnRenamed("doc_id", "page_id").join(pages, "page_id")


def substring_search(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, article_id)`` where the text or title contains the query, case ignored.

    The work over the texts does not grow with the number of queries, see ``contains_any``.
    """
    wanted = queries.select("query_id", F.lower(F.trim("query")).alias("needle")).where("needle <> ''")
    hay = articles.select("article_id", F.lower(F.concat_ws("\n", "title", "content_text")).alias("hay"))
    return contains_any(hay, "article_id", "hay", wanted, "query_id", "needle")


LITERAL_NEEDLES, AUTOMATON_CHARS = 64, 1_000_000  # needles tested one by one; characters of all needles in an automaton


def contains_any(hay: DataFrame, hay_id: str, text: str, needles: DataFrame, needle_id: str, needle: str,
                 limit: int = LITERAL_NEEDLES, keep: tuple[str, ...] = (), chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``(hay_id, *keep, needle_id, needle)`` for every needle that occurs in the text.

    Up to ``limit`` needles become a literal list. More of them, of at most ``chars`` characters together, are put into
    one automaton per task that finds all in a single pass over a text. Still larger tables meet the texts on the
    rarest trigram of each needle (shorter needles on themselves) and are then verified. Empty needles and missing texts
    match nothing.
    """
    few = needles.select(needle_id, needle).where(F.length(needle) > 0)
    kinds = dict(few.dtypes)
    size = few.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(needle)), F.lit(0)).alias("chars")).first()
    if size["n"] <= limit and size["chars"] <= AUTOMATON_CHARS:
        listed = F.array(*[
            F.struct(F.lit(r[0]).cast(kinds[needle_id]).alias(needle_id), F.lit(r[1]).alias(needle)) for r in few.collect()
        ]).cast(f"array<struct<{needle_id}:{kinds[needle_id]},{needle}:string>>")
        hits = F.filter(listed, lambda e: F.contains(F.col(text), e[needle]))
        return hay.select(hay_id, *keep, F.inline(hits))
    if size["chars"] <= chars:
        distinct = sorted({r[0] for r in few.select(needle).collect()})
        found = hay.select(hay_id, *keep, F.explode(_occurring(hay.sparkSession, distinct)(text)).alias(needle))
        return found.join(F.broadcast(few), needle).select(hay_id, *keep, needle_id, needle)
    return _by_rarest_trigram(hay, hay_id, text, few, needle_id, needle, keep)


def _occurring(spark: SparkSession, needles: list[str]) -> Callable[[str], Column]:
    """A function of a text column: the array of the needles that occur in it."""
    shared = spark.sparkContext.broadcast(needles)

    @F.pandas_udf("array<string>")
    def occurring(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in shared.value:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([sorted({n for _, n in automaton.iter(t)}) if t else [] for t in batch], dtype=object)

    return occurring


def _by_rarest_trigram(hay: DataFrame, hay_id: str, text: str, needles: DataFrame, needle_id: str, needle: str,
                       keep: tuple[str, ...]) -> DataFrame:
    def runs(col: str, *widths: int) -> Column:
        return F.array_distinct(F.concat(*[F.regexp_extract_all(col, F.lit(rf"(?s)(?=({'.' * w}))"), F.lit(1)) for w in widths]))

    own = F.when(F.length(needle) < 3, F.array(needle)).otherwise(runs(needle, 3))
    grams = cut_lineage(needles.select(needle).distinct().select(needle, F.explode(own).alias("gram")))
    held = hay.select(hay_id, F.explode(runs(text, 1, 2, 3)).alias("gram"))
    # a needle with a trigram that no text has is dropped: it occurs nowhere
    counts = cut_lineage(held.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")))
    rarest = grams.join(counts, "gram", "left").groupBy(needle).agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    met = held.join(rarest.drop("n"), "gram").drop("gram").join(hay.select(hay_id, text, *keep), hay_id).where(F.contains(text, F.col(needle)))
    return met.drop(text).join(needles, needle).select(hay_id, *keep, needle_id, needle)


def search(index: PostingIndex, queries: DataFrame, vectors: DataFrame | None = None,
           query_vectors: DataFrame | None = None, mode: str = "hybrid", k: int = 20, model: str | None = None,
           live: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank, mode)`` for mode hybrid, keyword or semantic.

    Both channels fetch ``2 k``; without vectors hybrid degrades to keyword and semantic is empty. Blank
    queries return nothing in any mode.
    """
    from .vector_search import vector_search

    asked = queries.where(F.trim("query") != "")
    if vectors is None and mode == "hybrid":
        mode = "keyword"
    if mode in ("hybrid", "keyword"):
        words = keyword_search(index, asked, 2 * k if mode == "hybrid" else k)
    if mode in ("hybrid", "semantic"):
        if vectors is None:
            return keyword_search(index, asked.limit(0), k).withColumn("mode", F.lit("keyword"))
        sem = vector_search(vectors, query_vectors.join(asked.select("query_id"), "query_id", "left_semi"),
                            2 * k if mode == "hybrid" else k, model, live).withColumnRenamed("similarity", "score")
    if mode == "hybrid":
        out = reciprocal_rank_fusion(words, sem, keys=["query_id"], item=["doc_id"], n=k)
    else:
        out = words if mode == "keyword" else sem
    return out.select("query_id", "doc_id", "score", "rank").withColumn("mode", F.lit(mode))


def page(ranked: DataFrame, articles: DataFrame, number: int, size: int, snippet: int = 200) -> DataFrame:
    """Rows of one result page with title and snippet."""
    # written, then sent to the texts where it is small
    cut = small_side(cut_lineage(ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))))
    text = articles.select(F.col("article_id").alias("doc_id"), "title", F.substring("content_text", 1, snippet).alias("snippet"))
    return cut.join(text, "doc_id")


def append_wiki(results: DataFrame, wiki_hits: DataFrame, k: int) -> DataFrame:
    """Article results, then wiki hits whose article is not among them, ``k`` per query.

    ``results``: query_id, doc_id, score, rank; ``wiki_hits``: query_id, page_id, kind, ref_id, rank. Page
    and article ids are different spaces, so pages are compared by the article they describe.
    """
    covered = results.select("query_id", F.col("doc_id").alias("ref_id"), F.lit("article").alias("kind"))
    extra = wiki_hits.join(covered, ["query_id", "ref_id", "kind"], "left_anti").select(
        "query_id", F.col("page_id").alias("id"), F.lit(0.0).alias("score"), F.lit("wiki").alias("source"),
        F.lit(1).alias("part"), "rank")
    own = results.select("query_id", F.col("doc_id").alias("id"), "score", F.lit("article").alias("source"),
                         F.lit(0).alias("part"), "rank")
    merged = own.unionByName(extra).withColumnRenamed("rank", "channel_rank")
    order = [F.col("part"), F.col("channel_rank"), F.col("id")]
    return top_per_group(merged, ["query_id"], order, k).drop("part", "channel_rank")


def search_all(keyword: DataFrame, semantic: DataFrame, wiki_keyword: DataFrame, pages: DataFrame, k: int = 20,
               wiki_penalty: float = 1.05) -> DataFrame:
    """Four-channel fusion over articles and wiki pages, by (kind, ref_id).

    Pages have no vectors: an article page inherits its article's distance, scaled by ``wiki_penalty``.
    """
    article = F.lit("article").alias("kind")
    dist = semantic.select("query_id", F.col("doc_id").alias("ref_id"), (1.0 - F.col("similarity")).alias("distance"), "rank")
    inherited = (
        dist.join(pages.where("kind = 'article'").select("ref_id", "page_id"), "ref_id")
        .select("query_id", F.col("page_id").alias("ref_id"), F.round(F.col("distance") * wiki_penalty, 6).alias("distance"))
    )
    wiki_sem = top_per_group(inherited, ["query_id"], [F.col("distance"), F.col("ref_id")], 3 * k)
    wiki = F.lit("wiki").alias("kind")
    return reciprocal_rank_fusion(
        keyword.select("query_id", article, F.col("doc_id").alias("ref_id"), "rank"),
        dist.select("query_id", article, "ref_id", "rank"),
        wiki_keyword.select("query_id", wiki, F.col("page_id").alias("ref_id"), "rank"),
        wiki_sem.select("query_id", wiki, "ref_id", "rank"),
        keys=["query_id"], item=["kind", "ref_id"], n=k)


def rerank(ranked: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """First ``top`` rows by supplied score, unscored rows and the rest keep their order behind them."""
    head = F.col("rank") <= top
    joined = ranked.join(scores.select("query_id", "doc_id", F.col("score").alias("rerank_score")), ["query_id", "doc_id"], "left")
    joined = joined.withColumn("rerank_score", F.when(head, F.col("rerank_score"))).withColumnRenamed("rank", "fused_rank")
    order = [F.when(F.col("fused_rank") <= top, 0).otherwise(1), F.col("rerank_score").desc_nulls_last(), F.col("fused_rank")]
    return top_per_group(joined, ["query_id"], order, 2**31 - 2)


def filter_corpus(articles: DataFrame, article_topics: DataFrame | None = None, feed_id: int | None = None,
                  topic_id: int | None = None, lang: str | None = None, status: str | None = None,
                  since=None, until=None) -> DataFrame:
    """Articles a search may return; plain predicates reach the scan."""
    out = articles.where(F.col("dedupe_of").isNull())
    for name, value in (("feed_id", feed_id), ("lang", lang), ("status", status)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("published_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("published_at") < F.lit(until).cast("timestamp"))
    if topic_id is not None:
        out = out.join(article_topics.where(F.col("topic_id") == topic_id).select("article_id"), "article_id", "left_semi")
    return out


def entity_facets(results: DataFrame, article_entities: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent entities over the results of each query."""
    counted = (
        results.select("query_id", F.col("doc_id").alias("article_id")).join(article_entities, "article_id")
        .groupBy("query_id", "entity_id").agg(F.count("*").alias("hits"))
    )
    return top_per_group(counted, ["query_id"], [F.col("hits").desc(), F.col("entity_id")], n)
