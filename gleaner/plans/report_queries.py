"""Sources, listings, reports, table functions and task analytics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import attempts as at, listings as ls, reports as rp, tables as tb
from ..operators.ranking import top_per_group
from ..sources import payloads as src, sinks
from . import base, oracle as O
from .registry import query, ts

NOW = "2024-01-03 00:00:00"

# ---- sources and sinks


@query("src_feed_xml", f"""
WITH d AS (SELECT doc_id, substr(source, 4)::BIGINT AS feed_id, substr(regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g'), 1, 80) AS t, text, lang,
  ts FROM documents JOIN events ON event_id = doc_id)
SELECT feed_id, 'https://h.example.com/' || doc_id AS source_url, trim(t) AS title,
  CASE WHEN lang = 'en' THEN trim(regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g')) ELSE '' END AS content_text,
  CASE WHEN lang = 'en' THEN '' ELSE '<p>' || trim(regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g')) || '</p>' END AS content_html,
  'A' || doc_id AS author, {O.ts('ts')} AS published_at FROM d WHERE trim(t) <> '' AND lang <> 'de'""")
def src_feed_xml(spark, sf):
    """Entries built from the documents: RSS for English, Atom for French and Spanish, German ones lack a link."""
    events = base.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    body = F.trim(F.regexp_replace("text", "[^A-Za-z0-9 .]", ""))
    rows = base.table(spark, sf, "documents").join(events, "doc_id").select(
        F.substring("source", 4, 10).cast("long").alias("feed_id"), "doc_id", "lang", "ts", body.alias("body"),
        F.substring(F.regexp_replace("text", "[^A-Za-z0-9 .]", ""), 1, 80).alias("t"))
    link = F.concat(F.lit("https://h.example.com/"), "doc_id")
    who = F.concat(F.lit("A"), "doc_id")
    rss = F.concat(
        F.lit("<item><title>"), "t", F.lit("</title>"), F.when(F.col("lang") == "en", F.concat(F.lit("<link>"), link, F.lit("</link>"))).otherwise(""),
        F.lit("<description>&lt;b&gt;"), "body", F.lit("&lt;/b&gt;</description><author>"), who, F.lit("</author><pubDate>"),
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(
        F.lit("<entry><title>"), "t", F.lit('</title><link rel="self" href="x"/><link href="'), link, F.lit('"/><content type="html">&lt;p&gt;'),
        "body", F.lit("&lt;/p&gt;</content><author><name>"), who, F.lit("</name></author><published>"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published></entry>"))
    xml = rows.select("feed_id", F.when(F.col("lang").isin("fr", "es"), atom).otherwise(rss).alias("xml"))
    return src.parse_feed(xml, "xml").withColumn("published_at", ts("published_at"))


@query("src_api_json", f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'https://x.example.com/' || event_id WHEN event_type = 'click' THEN event_id::VARCHAR ELSE '(no title)' END AS source_url,
  '(no title)' AS title, json_extract_string(props, '$.k') AS content_text, user_id::VARCHAR AS author,
  CASE WHEN event_type = 'view' THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(epoch(ts)::BIGINT), '%Y-%m-%d %H:%M:%S')
       WHEN event_type = 'click' THEN {O.ts('ts')} END AS published_at FROM (SELECT *, floor(epoch(ts)) AS e FROM events)""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def src_api_json(spark, sf):
    """One response per event: views carry a url and epoch time, clicks an id and ISO time, others neither."""
    kind = F.col("event_type")
    t = F.col("ts").cast("timestamp")
    doc = F.struct(
        F.struct(F.from_json("props", "k long").alias("data")).alias("body"), F.col("user_id").alias("by"),
        F.when(kind == "view", F.concat(F.lit("https://x.example.com/"), "event_id")).alias("url"),
        F.when(kind == "click", F.col("event_id")).alias("id"),
        F.when(kind == "view", F.unix_seconds(t)).alias("epoch"), F.when(kind == "click", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"))
    raw = base.table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct(F.array(doc).alias("items")).alias("data"))).alias("raw"))
    docs = src.explode_items(raw, "raw", "$.data.items", keep=["event_id"])
    mapper = {"time": ["epoch", "iso"], "content": "body.data.k"}
    return src.map_items(docs, "doc", mapper, keep=["event_id"]).withColumn("published_at", ts("published_at"))


@query("src_detail_join", """
SELECT feed_id, pos, id, body FROM (SELECT user_id AS feed_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)
JOIN (SELECT doc_id AS id, n_chars AS body FROM documents) USING (id) WHERE pos < 50""")
def src_detail_join(spark, sf):
    """Ids per user in order; documents are the details, ids without one are skipped."""
    events = base.table(spark, sf, "events").select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("id"))
    ids = events.withColumn("pos", (F.row_number().over(Window.partitionBy("feed_id").orderBy("id")) - 1).cast("long"))
    details = base.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("body"))
    return src.api_details(ids, details).select("feed_id", "pos", "id", "body")


@query("src_skip_unchanged", """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS body FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-10'
  AND NOT EXISTS (SELECT 1 FROM last WHERE last.user_id = e.user_id AND last.body = e.event_type)""")
def src_skip_unchanged(spark, sf):
    rows = base.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    out = src.skip_unchanged(rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut), "user_id", "event_type", "event_id")
    return out.select("event_id", "user_id", "event_type")


@query("src_feed_registry", "SELECT feed_id, name, url FROM feeds WHERE enabled AND env = 'prod'")
def src_feed_registry(spark, sf):
    return src.enabled_feeds(base.feeds(spark, sf), "prod").select("feed_id", "name", "url")


@query("src_limit_per_feed", """
WITH i AS (SELECT substr(source, 4)::BIGINT AS feed_id, doc_id AS item_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT feed_id, item_no, NULL::BIGINT AS dropped FROM i WHERE r <= 20
UNION ALL SELECT feed_id, NULL, count(*) - 20 FROM i GROUP BY 1 HAVING count(*) > 20""")
def src_limit_per_feed(spark, sf):
    items = base.table(spark, sf, "documents").select(F.substring("source", 4, 10).cast("long").alias("feed_id"), F.col("doc_id").alias("item_no"))
    kept, dropped = src.limit_per_feed(items, 20)
    none = F.lit(None).cast("long")
    return kept.select("feed_id", "item_no", none.alias("dropped")).unionByName(dropped.select("feed_id", none.alias("item_no"), "dropped"))


@query("snk_audit", "SELECT strftime(ts, '%Y-%m-%d') AS event_date, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def snk_audit(spark, sf):
    """Events appended to a day-partitioned log and read back."""
    from ..session import scratch_folder

    path = scratch_folder(spark, "audit")
    sinks.append_events(base.table(spark, sf, "events").select("event_id", "event_type", F.col("ts").alias("created_at")), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(F.count("*").alias("n"))


@query("snk_export_md", "SELECT slug AS name, md5(content_md) AS md5 FROM wiki")
def snk_export_md(spark, sf):
    from ..session import scratch_folder

    path = scratch_folder(spark, "export")
    sinks.export_pages(base.article_wiki(spark, sf), path)
    return spark.read.schema("name string, content_md string").json(path).select("name", F.md5("content_md").alias("md5"))


@query("snk_retention", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-04-15' - to_days(90)")
def snk_retention(spark, sf):
    rows = base.table(spark, sf, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    return sinks.retain(rows, "2024-04-15", 90).select("event_id", "event_type")


# ---- listings and dashboards


@query("article_list", f"""
SELECT article_id, title, status, lang, {O.ts('published_at')} AS published_at, feed_id FROM live
WHERE status = 'done' AND article_id IN (SELECT article_id FROM article_topics t JOIN topics USING (topic_id) WHERE name = '{base.PAGE_TOPIC}')
ORDER BY live.fetched_at DESC, article_id LIMIT 20 OFFSET 20""")
def article_list(spark, sf):
    arts = base.articles(spark, sf)
    return ls.list_articles(arts, base.feeds(spark, sf), base.article_topics(spark, sf), base.topics(spark), topic=base.PAGE_TOPIC,
                            status="done", page=2).select("article_id", "title", "status", "lang", ts("published_at"), "feed_id")


@query("article_list_query", f"""
SELECT article_id, title, {O.ts('published_at')} AS published_at FROM live WHERE feed_name = 'src3'
  AND article_id IN (SELECT doc_id FROM post WHERE term = 'the') ORDER BY live.fetched_at DESC, article_id LIMIT 20""")
def article_list_query(spark, sf):
    arts = base.articles(spark, sf)
    return ls.list_articles(arts, base.feeds(spark, sf), index=base.index(spark, sf), feed="src3", q=" the ").select(
        "article_id", "title", ts("published_at"))


@query("article_detail", """
WITH tr AS (SELECT article_id, arg_max(translated_content, seq) AS translation FROM translations GROUP BY 1),
en AS (SELECT article_id, string_agg(name, '|' ORDER BY ae.confidence DESC, entity_id) AS entities FROM article_entities ae JOIN entities USING (entity_id) GROUP BY 1),
tp AS (SELECT article_id, string_agg(name, '|' ORDER BY score DESC, name) AS topics FROM article_topics JOIN topics USING (topic_id) GROUP BY 1)
SELECT article_id, a.title, coalesce(summary_text, '') AS summary_text, coalesce(translation, '') AS translation, coalesce(en.entities, '') AS entities,
  coalesce(tp.topics, '') AS topics, coalesce(slug, '') AS slug
FROM articles a LEFT JOIN summaries USING (article_id) LEFT JOIN tr USING (article_id) LEFT JOIN en USING (article_id) LEFT JOIN tp USING (article_id)
LEFT JOIN wiki ON ref_id = article_id""")
def article_detail(spark, sf):
    arts = base.articles(spark, sf)
    found, told = base.mentions(spark, sf), base.stored(base.summaries(spark, sf))
    full = ls.details(arts, told, base.translations(spark, sf), base.entities(spark, sf, found),
                      base.article_entities(spark, sf, found), base.topics(spark), base.article_topics(spark, sf), base.article_wiki(spark, sf, told))
    text = lambda c: F.coalesce(c, F.lit(""))
    return full.select(
        "article_id", "title", text(F.col("summary_text")).alias("summary_text"), text(F.col("translated_content")).alias("translation"),
        text(F.array_join(F.transform("entities", lambda e: e["name"]), "|")).alias("entities"),
        text(F.array_join(F.transform("topics", lambda e: e["topic"]), "|")).alias("topics"), text(F.col("slug")).alias("slug"))


@query("translate_status", """
WITH done AS (SELECT article_id FROM (SELECT article_id, arg_max(translated_content, seq) AS t FROM translations GROUP BY 1) WHERE t <> '')
SELECT article_id, CASE WHEN article_id IN (SELECT article_id FROM done) THEN 'translated'
  WHEN article_id IN (SELECT article_id FROM states WHERE task = 'translate' AND status = 'queued') THEN 'translating' ELSE 'none' END AS state FROM articles""")
def translate_status(spark, sf):
    return ls.translation_state(base.articles(spark, sf), base.translations(spark, sf), base.states(spark, sf))


@query("corpus_counts", f"""
SELECT count_if(dedupe_of IS NULL)::BIGINT AS total, count_if(dedupe_of IS NULL AND fetched_at > TIMESTAMP '{NOW}' - to_days(1))::BIGINT AS last_day,
  count_if(status = 'pending')::BIGINT AS pending FROM articles""")
def corpus_counts(spark, sf):
    return ls.corpus_counts(base.articles(spark, sf), NOW)


@query("recent_articles", f"SELECT article_id, title, status, lang, {O.ts('published_at')} AS published_at FROM live ORDER BY live.fetched_at DESC, article_id LIMIT 20")
def recent_articles(spark, sf):
    return ls.recent_articles(base.articles(spark, sf)).select("article_id", "title", "status", "lang", ts("published_at"))


RUNS = """
WITH f AS (SELECT user_id AS feed_id, event_id AS seq, event_type = 'error' AS bad FROM events),
g AS (SELECT *, count_if(NOT bad) OVER (PARTITION BY feed_id ORDER BY seq) AS grp FROM f),
r AS (SELECT feed_id, seq, CASE WHEN bad THEN count_if(bad) OVER (PARTITION BY feed_id, grp ORDER BY seq) ELSE 0 END AS streak FROM g),
fs AS (SELECT feed_id, arg_max(streak, seq)::BIGINT AS fetch_failures, max(streak)::BIGINT AS longest_run, min(CASE WHEN streak >= 5 THEN seq END) AS disabled_at_seq FROM r GROUP BY 1)
"""
STATE = "CASE WHEN fetch_failures >= 5 THEN 'disabled' WHEN fetch_failures > 0 THEN 'degraded' ELSE 'healthy' END AS state"


@query("feed_health", RUNS + f"SELECT feed_id, fetch_failures, {STATE} FROM fs ORDER BY fetch_failures DESC, feed_id LIMIT 10")
def feed_health(spark, sf):
    return ls.feed_health(at.feed_state(base.fetch_log(spark, sf))).select("feed_id", "fetch_failures", "state")


@query("feed_disable", RUNS + f"SELECT feed_id, fetch_failures, longest_run, disabled_at_seq, {STATE} FROM fs")
def feed_disable(spark, sf):
    return at.feed_state(base.fetch_log(spark, sf))


@query("queue_stats", "SELECT status, count(*) AS n FROM states GROUP BY 1")
def queue_stats(spark, sf):
    return ls.queue_stats(base.states(spark, sf))


PERIOD = ("2024-01-01 06:00:00", "2024-01-02 06:00:00")
INSIDE = f"fetched_at BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"


@query("stats_total", f"SELECT count(*) AS articles_total FROM live WHERE {INSIDE}")
def stats_total(spark, sf):
    return rp.stats_total(base.articles(spark, sf), *PERIOD)


@query("stats_by_source", f"SELECT feed_name AS name, count(*) AS n_articles FROM live WHERE {INSIDE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def stats_by_source(spark, sf):
    return rp.stats_by_source(base.articles(spark, sf), base.feeds(spark, sf), *PERIOD)


def _report_sql(unit: str, days: int, kind: str) -> str:
    last = f"strftime(period_start + to_days({days - 1}), '%Y-%m-%d')"
    head = "strftime(period_start, '%Y-%m-%d')" + ("" if days == 1 else f" || ' - ' || {last}")
    return f"""
WITH a AS (SELECT date_trunc('{unit}', fetched_at)::DATE AS period_start, feed_name, article_id IN (SELECT article_id FROM summaries) AS s FROM live),
tot AS (SELECT period_start, count(*)::BIGINT AS articles_total, count_if(s)::BIGINT AS summaries_generated FROM a GROUP BY 1),
src AS (SELECT period_start, feed_name, count(*) AS n, row_number() OVER (PARTITION BY period_start ORDER BY count(*) DESC, feed_name) AS r FROM a GROUP BY 1, 2),
srcs AS (SELECT period_start, string_agg(feed_name || ':' || n, ', ' ORDER BY r) AS articles_by_source FROM src WHERE r <= 5 GROUP BY 1),
que AS (SELECT period_start, string_agg(outcome || ':' || n, ', ' ORDER BY outcome) AS queue_stats FROM (
  SELECT date_trunc('{unit}', ts)::DATE AS period_start, outcome, count(*) AS n FROM attempts GROUP BY 1, 2) GROUP BY 1)
SELECT '{kind}' AS report_type, strftime(period_start, '%Y-%m-%d') AS period_start, {last} AS period_end, articles_total, summaries_generated, articles_by_source,
  coalesce(queue_stats, '') AS queue_stats, '# ' || {head} || chr(10) || chr(10) || '- articles: ' || articles_total || chr(10) || '- sources: ' || articles_by_source
  || chr(10) || '- queue: ' || coalesce(queue_stats, '') || chr(10) AS content_md FROM tot JOIN srcs USING (period_start) LEFT JOIN que USING (period_start)"""


def _reports(spark, sf, period):
    arts = base.articles(spark, sf)
    out = rp.reports(arts, base.feeds(spark, sf), base.attempts(spark, sf), base.summaries(spark, sf), period)
    return out.withColumn("period_start", F.col("period_start").cast("string")).withColumn("period_end", F.col("period_end").cast("string"))


@query("report_daily", _report_sql("day", 1, "daily"))
def report_daily(spark, sf):
    return _reports(spark, sf, "daily")


@query("report_weekly", _report_sql("week", 7, "weekly"))
def report_weekly(spark, sf):
    return _reports(spark, sf, "weekly")


@query("report_growth", """
WITH c AS (SELECT 'topic' AS measure, name, date_trunc('week', fetched_at)::DATE AS week, count(*) AS n FROM article_topics JOIN live USING (article_id) JOIN topics USING (topic_id) GROUP BY 1, 2, 3
  UNION ALL SELECT 'entities_new', '', date_trunc('week', first_seen)::DATE, count(*) FROM entities GROUP BY 1, 2, 3
  UNION ALL SELECT 'relations_new', '', date_trunc('week', first_seen)::DATE, count(*) FROM relations GROUP BY 1, 2, 3),
k AS (SELECT measure, name, week FROM c UNION SELECT measure, name, week + 7 FROM c)
SELECT strftime(k.week, '%Y-%m-%d') AS week, measure, name, coalesce(c.n, 0) AS n, coalesce(p.n, 0) AS previous
FROM k LEFT JOIN c USING (measure, name, week) LEFT JOIN c p ON p.measure = k.measure AND p.name = k.name AND p.week = k.week - 7
WHERE k.week <= (SELECT max(date_trunc('week', fetched_at)) FROM live)""")
def report_growth(spark, sf):
    arts = base.articles(spark, sf)
    found = base.mentions(spark, sf)
    out = rp.growth(arts, base.article_topics(spark, sf), base.topics(spark), base.entities(spark, sf, found), base.relations(spark, sf, found))
    return out.withColumn("week", F.col("week").cast("string"))


@query("report_list", """
SELECT 'daily' AS report_type, strftime(d, '%Y-%m-%d') AS period_start, n::BIGINT AS articles_total FROM (
  SELECT date_trunc('day', fetched_at)::DATE AS d, count(*) AS n FROM live GROUP BY 1) ORDER BY d DESC LIMIT 30""")
def report_list(spark, sf):
    daily = _reports(spark, sf, "daily").select("report_type", "period_start", "articles_total")
    return rp.list_reports(daily, "daily")


# ---- table functions


@query("upsert_latest", f"""
SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1
UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25')""")
def upsert_latest(spark, sf):
    old = base.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = base.table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).select(
        F.col("user_id").alias("k"), F.col("event_type").alias("v"), "event_id")
    return tb.upsert_latest(old, new, ["k"], "event_id")


@query("upsert_guarded", """
SELECT article_id, CASE WHEN article_id NOT IN (SELECT vec_id FROM embeddings) THEN 'inserted' WHEN lang = 'en' THEN 'replaced' ELSE 'old' END AS v FROM articles
UNION ALL SELECT vec_id, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT article_id FROM articles)""")
def upsert_guarded(spark, sf):
    """Stored rows are those with a vector; new rows of other than English articles come from stale content."""
    arts = base.articles(spark, sf)
    old = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"), F.lit("-").alias("content_hash"), F.lit("old").alias("v"))
    held = old.select("article_id", F.lit(True).alias("held"))
    new = arts.join(held, "article_id", "left").select(
        "article_id", F.when(F.col("lang") == "en", F.col("content_hash")).otherwise(F.lit("stale")).alias("content_hash"),
        F.when(F.col("held"), "replaced").otherwise("inserted").alias("v"))
    return tb.upsert_guarded(old, new, arts, ["article_id"]).select("article_id", "v")


@query("insert_ignore", """
SELECT doc_id AS k, 'label' AS v FROM labels UNION ALL SELECT doc_id, 'doc' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_ignore(spark, sf):
    old = base.table(spark, sf, "labels").select(F.col("doc_id").alias("k"), F.lit("label").alias("v"))
    return tb.insert_ignore(old, base.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.lit("doc").alias("v")), ["k"])


@query("cascade_delete", """
SELECT 'lineitem' AS t, l_orderkey AS k, l_linenumber::BIGINT AS n, NULL::BIGINT AS ref FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'orders', o_orderkey, NULL, CASE WHEN c_mktsegment <> 'BUILDING' THEN o_custkey END FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'""")
def cascade_delete(spark, sf):
    """Deleted orders take their lines; deleted customers leave a null reference."""
    orders = base.table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    customers = base.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    lines = tb.cascade(base.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_orderkey")
    kept = tb.null_missing(orders, customers, "o_custkey", "c_custkey")
    none = F.lit(None).cast("long")
    return lines.select(F.lit("lineitem").alias("t"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), none.alias("ref")).unionByName(
        kept.select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("k"), none.alias("n"), F.col("o_custkey").alias("ref")))


@query("integrity_check", """
SELECT 'unique:article' AS check_name, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'unique:content', (SELECT count(*) FROM (SELECT content_hash FROM articles GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'fk:vector_article', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'fk:event_user', (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'check:status', (SELECT count(*) FROM articles WHERE status NOT IN ('pending', 'processing', 'done'))
UNION ALL SELECT 'check:dim', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64)""")
def integrity_check(spark, sf):
    arts, vec = base.articles(spark, sf), base.table(spark, sf, "embeddings")
    return tb.violations(
        tb.duplicates(arts, ["article_id"], "article"), tb.duplicates(arts, ["content_hash"], "content"),
        tb.orphans(vec, "vec_id", arts, "article_id", "vector_article"),
        tb.orphans(base.table(spark, sf, "events"), "user_id", base.table(spark, sf, "customer"), "c_custkey", "event_user"),
        tb.outside(arts, F.col("status").isin("pending", "processing", "done"), "status"),
        tb.outside(vec, F.size("embedding") == 64, "dim"))


# ---- task attempts


@query("job_current", f"SELECT article_id, task, seq, {O.ts('ts')} AS ts, outcome, status FROM states")
def job_current(spark, sf):
    return base.states(spark, sf).withColumn("ts", ts("ts"))


@query("job_superseded", """
SELECT article_id, task, seq FROM (SELECT *, max(seq) OVER (PARTITION BY article_id, task) AS newest FROM attempts WHERE outcome = 'queued') WHERE seq < newest""")
def job_superseded(spark, sf):
    return at.superseded(base.attempts(spark, sf)).select("article_id", "task", "seq")


@query("job_outcome", """
WITH j AS (SELECT *, count_if(outcome = 'queued') OVER (PARTITION BY article_id, task ORDER BY seq) AS job FROM attempts),
g AS (SELECT *, count_if(outcome = 'permanent') OVER (PARTITION BY article_id, task, job ORDER BY seq) AS spent,
  count_if(outcome <> 'timeout') OVER (PARTITION BY article_id, task, job ORDER BY seq) AS grp FROM j),
t AS (SELECT *, CASE WHEN outcome = 'timeout' THEN count_if(outcome = 'timeout') OVER (PARTITION BY article_id, task, job, grp ORDER BY seq) ELSE 0 END AS timeouts FROM g),
d AS (SELECT *, min(CASE WHEN spent >= 3 OR timeouts >= 3 THEN seq END) OVER (PARTITION BY article_id, task, job) AS died_at FROM t)
SELECT article_id, task, job::BIGINT AS job, seq, outcome, spent::BIGINT AS spent, timeouts::BIGINT AS timeouts,
  CASE WHEN seq > died_at THEN 'ignored' WHEN seq = died_at THEN 'dead' WHEN outcome IN ('timeout', 'transient', 'permanent') THEN 'retry' ELSE outcome END AS verdict FROM d""")
def job_outcome(spark, sf):
    return at.outcomes(base.attempts(spark, sf))


@query("job_payload_merge", """
SELECT article_id, task, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT article_id, task, unnest([seq % 7, seq % 11]) AS id FROM attempts WHERE outcome = 'queued') GROUP BY 1, 2""")
def job_payload_merge(spark, sf):
    batches = base.attempts(spark, sf).where("outcome = 'queued'").select("article_id", "task", F.array(F.col("seq") % 7, F.col("seq") % 11).alias("ids"))
    return at.merge_payloads(batches).withColumn("ids", F.array_join("ids", ","))


@query("article_done", """
SELECT article_id FROM live WHERE status = 'processing' AND article_id NOT IN (SELECT article_id FROM states WHERE status = 'queued' AND task <> 'translate')""")
def article_done(spark, sf):
    return at.finished(base.articles(spark, sf), base.states(spark, sf)).select("article_id")


@query("job_backfill", """
SELECT article_id, content_hash, task FROM live, (VALUES ('embed_core'), ('summarize')) t(task) WHERE status = 'pending' AND article_id NOT IN (SELECT article_id FROM states)""")
def job_backfill(spark, sf):
    return at.unstarted(base.articles(spark, sf), base.states(spark, sf))


CLEAN_NOW = "2024-01-30 12:00:00"


@query("job_cleanup", f"SELECT article_id, task, seq FROM states WHERE NOT (status = 'succeeded' AND ts < TIMESTAMP '{CLEAN_NOW}' - to_hours(24))")
def job_cleanup(spark, sf):
    return at.prune(base.states(spark, sf), CLEAN_NOW).select("article_id", "task", "seq")
