"""Shared SQL fragments for the cross-check engine: the corpus model over the same parquet views."""

from __future__ import annotations

import re

from . import base

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NL = "chr(10)"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


# the fixed labels of a page are its only CJK text: written out as their 1- and 2-grams
PAGE_TOKENS = tok("replace(replace(title || ' ' || content_md, '要点', '要 点 要点'), '原文', '原 文 原文')")


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}'), lambda w: w <> ''))"


def sents(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?。！？])[ \n]+', '\1' || {NL}, 'g')"
    return f"list_filter(list_transform(string_split({marked}, {NL}), lambda s: {norm('s')}), lambda s: s <> '')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v}::BIGINT"
    if isinstance(v, float):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def entity_id(kind: str, name: str) -> str:
    return f"('0x' || substr(md5(length({kind}) || ':' || {kind} || ':' || {name}), 1, 15))::BIGINT"


def slug(title: str) -> str:
    a = rf"regexp_replace(trim(lower({title})), '[^\p{{L}}\p{{M}}\p{{Nd}}_\s-]', '', 'g')"
    b = rf"regexp_replace({a}, '[\s_]+', '-', 'g')"
    return f"regexp_replace(substr({b}, 1, 100), '^-+|-+$', '', 'g')"


CTES = {
    "meta": """
        SELECT event_id AS article_id, ts AS fetched_at, ts - to_hours(event_id % 7) AS published_at,
               CASE event_type WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'processing'
                               WHEN 'error' THEN 'error' ELSE 'done' END AS status FROM events""",
    "raw_articles": f"""
        SELECT doc_id AS article_id, substr(source, 4)::BIGINT AS feed_id, source AS feed_name,
               'https://' || source || '.example.com/a/' || doc_id AS source_url,
               split_part(text, {NL}, 1) AS title, text AS content_text, lang, fetched_at, published_at, status,
               sha256({norm('text')}) AS content_hash, length({norm('text')}) AS norm_len
        FROM documents JOIN meta ON article_id = doc_id""",
    "firsts": "SELECT content_hash, arg_min(article_id, (fetched_at, article_id)) AS first_id FROM raw_articles GROUP BY 1",
    "articles": """
        SELECT a.*, CASE WHEN first_id <> article_id THEN first_id END AS dedupe_of
        FROM raw_articles a JOIN firsts USING (content_hash)""",
    "live": "SELECT * FROM articles WHERE dedupe_of IS NULL",
    "feeds": """
        SELECT DISTINCT substr(source, 4)::BIGINT AS feed_id, source AS name, 'https://' || source || '.example.com/feed.xml' AS url,
               CASE WHEN substr(source, 4)::BIGINT % 2 = 0 THEN 'prod' ELSE 'dev' END AS env,
               substr(source, 4)::BIGINT % 5 <> 4 AS enabled FROM documents""",
    "topics(topic_id, name, description, keywords, enabled)": values(base.TOPICS),
    "keywords": "SELECT topic_id, lower(trim(unnest(keywords))) AS kw FROM topics WHERE enabled",
    "article_topics": """
        SELECT article_id, topic_id,
               round(least(1.0, count(*) * 0.2 + count_if(contains(lower(title), kw)) * 0.3), 6)::DOUBLE AS score, 'keyword' AS method
        FROM articles JOIN keywords ON contains(lower(title || ' ' || content_text), kw) GROUP BY 1, 2""",
    "gaz(alias, name, type)": values(base.ALIASES),
    "sent": f"SELECT article_id, unnest(range(len(l))) AS sentence, unnest(l) AS s FROM (SELECT article_id, {sents('content_text')} AS l FROM articles)",
    "senttok": f"SELECT article_id, sentence, {tok('s')} AS t FROM sent",
    "grams": """
        SELECT article_id, sentence, pos, array_to_string(t[pos:pos + n - 1], ' ') AS alias
        FROM (SELECT article_id, sentence, t, unnest(range(1, len(t) + 1)) AS pos FROM senttok), (VALUES (1), (2), (3)) v(n)
        WHERE pos + n - 1 <= len(t)""",
    "mentions": f"""
        SELECT article_id, sentence, pos, name, type, alias AS surface, {entity_id('type', 'name')} AS entity_id,
               CASE WHEN alias = lower(name) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM grams JOIN gaz USING (alias)""",
    "article_entities": """
        SELECT article_id, entity_id, max(confidence) AS confidence, arg_max(surface, (sentence, pos, surface)) AS surface
        FROM mentions GROUP BY 1, 2""",
    "entities": """
        SELECT entity_id, type, name, max(confidence) AS confidence, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen,
               list_sort(list_distinct(list(surface))) AS aliases, count(DISTINCT article_id) AS mention_count,
               name || ' is a ' || type AS description
        FROM mentions JOIN meta USING (article_id) GROUP BY 1, 2, 3""",
    "pairs_next": """
        SELECT article_id, name AS subject, confidence, lead(name) OVER w AS object, lead(confidence) OVER w AS c2, entity_id AS subject_id,
               lead(entity_id) OVER w AS object_id
        FROM mentions WINDOW w AS (PARTITION BY article_id, sentence ORDER BY pos, name, type, surface)""",
    "resolved": """
        SELECT article_id, subject_id, 'co_mentioned_with' AS predicate, object_id, least(confidence, c2) AS confidence
        FROM pairs_next WHERE object IS NOT NULL AND object <> subject""",
    "relations": """
        SELECT subject_id, predicate, object_id, max(confidence) AS confidence, count(DISTINCT article_id) AS n_articles,
               min(fetched_at) AS first_seen, max(fetched_at) AS last_seen
        FROM resolved JOIN meta USING (article_id) GROUP BY 1, 2, 3""",
    # term index of the live articles
    "ix": f"SELECT article_id AS doc_id, {tok('title || chr(32) || content_text')} AS t FROM live",
    "post": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM ix) GROUP BY 1, 2",
    "stat": "SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ix",
    "dfs": "SELECT term, count(*) AS df FROM post GROUP BY 1",
    "q0": rf"""
        SELECT item_id AS query_id, list_filter({tok('text')}, lambda x: length(x) >= 4) AS t,
               {tok(chr(39).join(['regexp_extract(text, ', r'^(\S+ \S+)', ', 1)']))} AS lead FROM benchmark""",
    "qs": "SELECT * FROM q0 WHERE len(t) >= 2",
    "alts": """
        SELECT query_id, 0 AS alt, CASE query_id % 4 WHEN 0 THEN list_distinct([t[1], t[2]]) WHEN 1 THEN list_distinct(lead) ELSE [t[1]] END AS pos,
               CASE WHEN query_id % 4 = 1 AND len(lead) > 1 THEN array_to_string(lead, ' ') END AS phrase,
               CASE WHEN query_id % 4 = 3 THEN t[2] END AS neg
        FROM qs WHERE query_id % 4 <> 1 OR len(lead) > 0
        UNION ALL SELECT query_id, 1, [t[2]], NULL, NULL FROM qs WHERE query_id % 4 = 2""",
    "altterms": "SELECT query_id, alt, len(pos) AS need, phrase, neg, unnest(pos) AS term FROM alts",
    "altdocs": """
        SELECT query_id, alt, p.doc_id, any_value(phrase) AS phrase, any_value(neg) AS neg,
               sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ix.t) / avgdl))) AS s
        FROM altterms JOIN post p USING (term) JOIN dfs USING (term) JOIN ix ON ix.doc_id = p.doc_id, stat
        GROUP BY 1, 2, 3 HAVING count(*) = any_value(need)""",
    "kwscore": """
        SELECT query_id, doc_id, round(max(s), 6) AS score FROM altdocs JOIN ix USING (doc_id)
        WHERE (phrase IS NULL OR contains(' ' || array_to_string(t, ' ') || ' ', ' ' || phrase || ' ')) AND (neg IS NULL OR NOT list_contains(t, neg))
        GROUP BY 1, 2""",
    "kw": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kwscore",
    "vectors": """
        SELECT vec_id // 2 AS article_id, CASE WHEN vec_id % 2 = 0 THEN 'body' ELSE 'title' END AS kind,
               CASE WHEN label >= 8 THEN 'old' ELSE 'active' END AS model, embedding::DOUBLE[] AS v FROM embeddings""",
    "qv": "SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)",
    "semscore": """
        SELECT query_id, article_id AS doc_id, round(max(list_cosine_similarity(qv.v, vectors.v)), 6) AS similarity
        FROM qv, vectors JOIN live USING (article_id) WHERE model = 'active' GROUP BY 1, 2""",
    "sem": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM semscore",
    # the semantic channel of hybrid search asks only for queries that have a text
    "semq": "SELECT * FROM sem WHERE query_id IN (SELECT query_id FROM qs)",
    "hybrid": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
          SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
            SELECT query_id, doc_id, rank FROM kw WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM semq WHERE rank <= 40)
          GROUP BY 1, 2)""",
    "attempts": f"""
        SELECT user_id AS article_id, {lit(base.TASKS)}[event_id % 7 + 1] AS task, event_id AS seq, ts,
               CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'permanent' WHEN 'signup' THEN 'transient'
                               WHEN 'click' THEN 'succeeded' ELSE 'queued' END AS outcome FROM events""",
    "states": """
        SELECT article_id, task, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(outcome, seq) AS outcome,
               CASE WHEN arg_max(outcome, seq) = 'succeeded' THEN 'succeeded' ELSE 'queued' END AS status FROM attempts GROUP BY 1, 2""",
    # leading sentences as summary and key points; articles in error have none
    "summaries": f"""
        SELECT article_id, l[1] AS summary_text, l[2:4] AS key_points FROM (SELECT article_id, status, {sents('content_text')} AS l FROM articles)
        WHERE len(l) > 0 AND status <> 'error'""",
    "translations": "SELECT conv_id AS article_id, turn AS seq, role AS translated_title, text AS translated_content FROM conversations",
    "wiki": f"""
        SELECT article_id * 4 AS page_id, 'article' AS kind, article_id AS ref_id, title,
               (CASE WHEN {slug('title')} <> '' THEN {slug('title')} ELSE 'article' END) || '-' || article_id AS slug,
               array_to_string(list_filter(['# ' || title || {NL}, CASE WHEN coalesce(summary_text, '') <> '' THEN summary_text || {NL} END,
                 CASE WHEN len(key_points) > 0 THEN '## 要点' || {NL} END,
                 CASE WHEN len(key_points) > 0 THEN array_to_string(list_transform(key_points, lambda p: '- ' || p), {NL}) END,
                 CASE WHEN len(key_points) > 0 THEN '' END, '原文: ' || source_url], lambda x: x IS NOT NULL), {NL}) AS content_md
        FROM articles LEFT JOIN summaries USING (article_id) WHERE title <> ''""",
    "best_topic": """
        SELECT topic_id, article_id, score, published_at,
               row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, published_at DESC, article_id) AS rank
        FROM article_topics JOIN live USING (article_id)""",
    "rel_topic": """
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, published_at DESC, related_id) AS rank FROM (
          SELECT x.article_id, y.article_id AS related_id, max(y.score) AS score, any_value(l.published_at) AS published_at
          FROM article_topics x JOIN article_topics y ON x.topic_id = y.topic_id AND x.article_id <> y.article_id
          JOIN live l ON l.article_id = y.article_id GROUP BY 1, 2) QUALIFY rank <= 5""",
    "rel_entity": """
        SELECT *, round(0.5 + least(shared * 0.1, 0.5), 6)::DOUBLE AS score,
               row_number() OVER (PARTITION BY article_id ORDER BY shared DESC, published_at DESC, related_id) AS rank FROM (
          SELECT x.article_id, y.article_id AS related_id, count(*) AS shared, any_value(l.published_at) AS published_at
          FROM article_entities x JOIN article_entities y ON x.entity_id = y.entity_id AND x.article_id <> y.article_id
          JOIN live l ON l.article_id = y.article_id GROUP BY 1, 2) QUALIFY rank <= 5""",
    "rel_feed": """
        SELECT a.article_id, b.article_id AS related_id, 0.3::DOUBLE AS score,
               row_number() OVER (PARTITION BY a.article_id ORDER BY b.published_at DESC, b.article_id) AS rank
        FROM articles a JOIN live b ON a.feed_id = b.feed_id AND a.article_id <> b.article_id QUALIFY rank <= 3""",
    "related": """
        SELECT article_id, related_id, src, score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, priority, place) AS rank FROM (
          SELECT article_id, related_id, arg_min(src, priority) AS src, arg_min(score, priority) AS score, min(priority) AS priority,
                 arg_min(rank, priority) AS place FROM (
            SELECT article_id, related_id, score, rank, 'topic' AS src, 0 AS priority FROM rel_topic
            UNION ALL SELECT article_id, related_id, score, rank, 'entity', 1 FROM rel_entity
            UNION ALL SELECT article_id, related_id, score, rank, 'feed', 2 FROM rel_feed) GROUP BY 1, 2) QUALIFY rank <= 10""",
}


def sql(body: str) -> str:
    """``body`` with the shared fragments it names, directly or through others, in front."""
    names = [n.split("(")[0] for n in CTES]
    uses = {n: {m for m in names if re.search(rf"\b{m}\b", text)} - {n} for n, text in zip(names, CTES.values())}
    wanted, todo = set(), {n for n in names if re.search(rf"\b{n}\b", body)}
    while todo:
        n = todo.pop()
        wanted.add(n)
        todo |= uses[n] - wanted
    parts = [f"{head} AS ({text})" for head, text in CTES.items() if head.split("(")[0] in wanted]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return "WITH RECURSIVE " + ",\n".join([*parts, body[own.end():]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
