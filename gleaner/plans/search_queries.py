"""Keyword, vector and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index as ix, ranking, search, vector_search
from . import base, oracle as O
from .registry import query


@query("index_build", f"""
WITH d AS (SELECT article_id AS doc_id, title || ' ' || content_text || coalesce(' ' || summary_text, '') ||
   CASE WHEN summary_text IS NOT NULL THEN ' ' || array_to_string(key_points, ' ') ELSE '' END AS raw FROM articles LEFT JOIN summaries USING (article_id)),
t AS (SELECT doc_id, {O.tok('raw')} AS t FROM d)
SELECT doc_id, len(t)::BIGINT AS dl, len(list_distinct(t))::BIGINT AS n_terms, md5(array_to_string(list_sort(t), ' ')) AS terms_md5 FROM t""")
def index_build(spark, sf):
    built = ix.build_index(base.raw_articles(spark, sf), base.summaries(spark, sf))
    flat = F.flatten(F.transform(F.map_entries("terms"), lambda e: F.array_repeat(e["key"], e["value"])))
    return built.select("doc_id", F.col("dl").cast("long"), F.size("terms").cast("long").alias("n_terms"),
                        F.md5(F.array_join(F.sort_array(flat), " ")).alias("terms_md5"))


@query("index_missing", f"""
SELECT article_id AS doc_id, len({O.tok("title || ' ' || content_text")})::BIGINT AS dl FROM articles
WHERE article_id NOT IN (SELECT vec_id FROM embeddings)""")
def index_missing(spark, sf):
    """Only the articles an existing index lacks; here the index is said to hold those with a vector."""
    have = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return ix.build_index(base.articles(spark, sf), only_missing=have).select("doc_id", F.col("dl").cast("long"))


@query("wiki_index", f"""
SELECT page_id AS doc_id, len({O.PAGE_TOKENS})::BIGINT AS dl, len(list_distinct({O.PAGE_TOKENS}))::BIGINT AS n_terms FROM wiki""")
def wiki_index(spark, sf):
    return ix.build_wiki_index(base.article_wiki(spark, sf)).select("doc_id", F.col("dl").cast("long"), F.size("terms").cast("long").alias("n_terms"))


@query("kw_search", "SELECT query_id, doc_id, score, rank FROM kw WHERE rank <= 20")
def kw_search(spark, sf):
    return search.keyword_search(base.index(spark, sf), base.queries(spark, sf), 20)


WIKI_KW = f"""
WITH wix AS (SELECT page_id AS doc_id, {O.PAGE_TOKENS} AS t FROM wiki),
wpost AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM wix) GROUP BY 1, 2),
wstat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM wix), wdf AS (SELECT term, count(*) AS df FROM wpost GROUP BY 1),
wdoc AS (SELECT query_id, alt, p.doc_id, any_value(phrase) AS phrase, any_value(neg) AS neg,
   sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(wix.t) / avgdl))) AS s
   FROM altterms JOIN wpost p USING (term) JOIN wdf USING (term) JOIN wix ON wix.doc_id = p.doc_id, wstat GROUP BY 1, 2, 3 HAVING count(*) = any_value(need)),
wkw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM (
   SELECT query_id, doc_id AS page_id, round(max(s), 6) AS score FROM wdoc JOIN wix USING (doc_id)
   WHERE (phrase IS NULL OR contains(' ' || array_to_string(t, ' ') || ' ', ' ' || phrase || ' ')) AND (neg IS NULL OR NOT list_contains(t, neg)) GROUP BY 1, 2))
"""


@query("kw_search_wiki", WIKI_KW + "SELECT query_id, page_id, score, rank, kind, ref_id, title, slug FROM wkw JOIN wiki USING (page_id) WHERE rank <= 20")
def kw_search_wiki(spark, sf):
    pages = base.article_wiki(spark, sf)
    hits = search.keyword_search_wiki(base.wiki_index(spark, pages), pages, base.queries(spark, sf), 20)
    return hits.select("query_id", "page_id", "score", "rank", "kind", "ref_id", "title", "slug")


@query("kw_like", f"""
WITH n AS (SELECT item_id AS query_id, lower({O.norm('text')}) AS needle FROM benchmark)
SELECT query_id, article_id FROM n JOIN articles ON contains(lower(title || chr(10) || content_text), needle)""")
def kw_like(spark, sf):
    """Which articles contain a benchmark passage word for word."""
    wanted = base.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.squash(F.col("text")).alias("query"))
    return search.substring_search(base.articles(spark, sf), wanted).select("query_id", "article_id")


def _live(spark, sf):
    return base.articles(spark, sf).where("dedupe_of is null").select("article_id")


def _semantic(spark, sf, k):
    return vector_search.vector_search(base.vectors(spark, sf), base.query_vectors(spark, sf), k, "active", _live(spark, sf))


@query("vec_search", "SELECT query_id, doc_id, similarity, rank FROM sem WHERE rank <= 10")
def vec_search(spark, sf):
    return _semantic(spark, sf, 10)


@query("vec_search_recall", "SELECT count(*) AS n_exact, true AS enough FROM sem WHERE rank <= 10")
def vec_search_recall(spark, sf):
    """Whether the faster search, which takes 0.3 of a cell's radius, finds nine of ten true neighbours; both over all vectors."""
    found = vector_search.vector_search(base.vectors(spark, sf), base.query_vectors(spark, sf), 10, "active", _live(spark, sf), reach=0.3)
    return vector_search.recall(found, _semantic(spark, sf, 10)).select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query("rrf_fuse", """
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
    SELECT query_id, doc_id, rank FROM kw WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM sem WHERE rank <= 20) GROUP BY 1, 2) QUALIFY rank <= 10""")
def rrf_fuse(spark, sf):
    words = search.keyword_search(base.index(spark, sf), base.queries(spark, sf), 20)
    return ranking.reciprocal_rank_fusion(words, _semantic(spark, sf, 20), keys=["query_id"], item=["doc_id"], n=10)


def _hybrid(spark, sf, k):
    return search.search(base.index(spark, sf), base.queries(spark, sf), base.vectors(spark, sf), base.query_vectors(spark, sf),
                         "hybrid", k, "active", _live(spark, sf))


@query("hybrid_search", "SELECT query_id, doc_id, score, rank, 'hybrid' AS mode FROM hybrid WHERE rank <= 20")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, 20)


@query("search_page", """
SELECT query_id, doc_id, score, rank, title, substr(content_text, 1, 200) AS snippet FROM hybrid JOIN articles ON article_id = doc_id
WHERE rank BETWEEN 11 AND 20""")
def search_page(spark, sf):
    return search.page(_hybrid(spark, sf, 20).drop("mode"), base.texts(spark, sf), 2, 10)


@query("search_with_wiki", WIKI_KW + """
, res AS (SELECT query_id, doc_id, score, rank FROM hybrid WHERE rank <= 20),
mix AS (SELECT query_id, doc_id AS id, score, 'article' AS source, 0 AS part, rank AS cr FROM res
  UNION ALL SELECT query_id, page_id, 0.0, 'wiki', 1, rank FROM wkw JOIN wiki USING (page_id) WHERE rank <= 30
    AND NOT EXISTS (SELECT 1 FROM res WHERE res.query_id = wkw.query_id AND res.doc_id = wiki.ref_id))
SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY part, cr, id) AS rank FROM mix QUALIFY rank <= 30""")
def search_with_wiki(spark, sf):
    pages = base.article_wiki(spark, sf)
    hits = search.keyword_search_wiki(base.wiki_index(spark, pages), pages, base.queries(spark, sf), 30)
    return search.append_wiki(_hybrid(spark, sf, 20), hits, 30)


@query("search_wiki_rrf", WIKI_KW + """
, inh AS (SELECT query_id, page_id, round((1.0 - similarity) * 1.05, 6) AS d FROM sem JOIN wiki ON ref_id = doc_id WHERE rank <= 60),
wsem AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY d, page_id) AS rank FROM inh QUALIFY rank <= 60),
ch AS (SELECT query_id, 'article' AS kind, doc_id AS ref_id, rank FROM kw WHERE rank <= 60 UNION ALL SELECT query_id, 'article', doc_id, rank FROM sem WHERE rank <= 60
  UNION ALL SELECT query_id, 'wiki', page_id, rank FROM wkw WHERE rank <= 60 UNION ALL SELECT query_id, 'wiki', page_id, rank FROM wsem)
SELECT query_id, kind, ref_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, ref_id) AS rank FROM (
  SELECT query_id, kind, ref_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ch GROUP BY 1, 2, 3) QUALIFY rank <= 20""")
def search_wiki_rrf(spark, sf):
    pages, asked = base.article_wiki(spark, sf), base.queries(spark, sf)
    words = search.keyword_search(base.index(spark, sf), asked, 60)
    wiki_words = search.keyword_search_wiki(base.wiki_index(spark, pages), pages, asked, 60)
    return search.search_all(words, _semantic(spark, sf, 60), wiki_words, pages, 20)


@query("rerank_apply", """
WITH hyb30 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM kw WHERE rank <= 60
    UNION ALL SELECT query_id, doc_id, rank FROM semq WHERE rank <= 60) GROUP BY 1, 2)),
h AS (SELECT query_id, doc_id, score, hyb30.rank AS fused_rank, CASE WHEN hyb30.rank <= 20 THEN (quality * 2 + toxic)::DOUBLE END AS rerank_score
  FROM hyb30 LEFT JOIN labels USING (doc_id) WHERE hyb30.rank <= 30)
SELECT query_id, doc_id, score, fused_rank, rerank_score, row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN fused_rank <= 20 THEN 0 ELSE 1 END, rerank_score DESC NULLS LAST, fused_rank) AS rank FROM h""")
def rerank_apply(spark, sf):
    ranked = base.stored(_hybrid(spark, sf, 30).drop("mode"))  # read for the scores and for the ranks
    labels = base.table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("score"))
    scores = ranked.select("query_id", "doc_id").join(labels, "doc_id")
    return search.rerank(ranked, scores, 20)


@query("similar_articles", """
WITH s AS (SELECT vec_id AS article_id, embedding::DOUBLE[] AS v, lang, dedupe_of FROM embeddings JOIN articles ON article_id = vec_id),
f AS (SELECT a.article_id, b.article_id AS similar_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim,
  row_number() OVER (PARTITION BY a.article_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.article_id) AS r
  FROM s a JOIN s b ON a.lang = b.lang AND a.article_id <> b.article_id AND b.dedupe_of IS NULL QUALIFY r <= 30),
g AS (SELECT article_id, similar_id, round(1.0 / (2.0 - sim) + 0.3 * coalesce((SELECT max(y.score) FROM article_topics x JOIN article_topics y USING (topic_id)
  WHERE x.article_id = f.article_id AND y.article_id = f.similar_id), 0.0), 6) AS score FROM f)
SELECT article_id, similar_id, score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, similar_id) AS rank FROM g QUALIFY rank <= 10""")
def similar_articles(spark, sf):
    arts = base.stored(base.articles(spark, sf).select("article_id", "lang", "dedupe_of"))
    vec = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    return vector_search.similar(vec, arts, base.stored(base.article_topics(spark, sf)), 10)


@query("search_filters", """
WITH keep AS (SELECT article_id FROM live WHERE lang = 'en' AND published_at >= TIMESTAMP '2024-01-01 06:00:00' AND published_at < TIMESTAMP '2024-01-20 00:00:00'
  AND article_id IN (SELECT article_id FROM article_topics WHERE topic_id = 5)),
s AS (SELECT query_id, article_id AS doc_id, round(max(list_cosine_similarity(qv.v, vectors.v)), 6) AS similarity FROM qv, vectors JOIN keep USING (article_id)
  WHERE model = 'active' GROUP BY 1, 2)
SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def search_filters(spark, sf):
    arts = base.articles(spark, sf)
    kept = search.filter_corpus(arts, base.article_topics(spark, sf), topic_id=5, lang="en",
                                since="2024-01-01 06:00:00", until="2024-01-20 00:00:00")
    return vector_search.vector_search(base.vectors(spark, sf), base.query_vectors(spark, sf), 10, "active", kept)


@query("search_entity_facets", """
SELECT query_id, entity_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, entity_id) AS rank
FROM (SELECT query_id, entity_id, count(*) AS hits FROM kw JOIN article_entities ON article_id = doc_id WHERE kw.rank <= 20 GROUP BY 1, 2) QUALIFY rank <= 5""")
def search_entity_facets(spark, sf):
    hits = search.keyword_search(base.index(spark, sf), base.queries(spark, sf), 20)
    return search.entity_facets(hits, base.article_entities(spark, sf))
