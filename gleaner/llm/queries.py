"""The operators over the driver's tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder
from . import exact_radix, fuzzy_lines, gray_index, language, lexical, licences, packing, phrase_index, repeated_spans, set_sketch, spelling, token_planes, url_filter
from .common import table
from .registry import query


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_planes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "token-planes")
    token_planes.write_ids(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_planes.document_sums(spark, path)


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, pages = table(spark, folder, "documents"), language.page_evidence(table(spark, folder, "pages"))
    return language.identified(language.labelled(docs), pages=pages).drop("dkey")


@query("op3_fuzzy_lines")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_lines.line_report(table(spark, folder, "documents"))


@query("op4_exact_radix", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact_radix.exact_groups(table(spark, folder, "documents"))


WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _templates() -> str:
    rows = [(i, text, label, i < len(licences.PHRASES)) for i, (text, label) in enumerate([*licences.PHRASES, *licences.NOTICES])]
    return ", ".join(f"({i}, '{text}', '{label}', {base})" for i, text, label, base in rows)


@query("op5_licences", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
t AS MATERIALIZED (SELECT template, label, base, {WORDS} AS w FROM (VALUES {_templates()}) AS v(template, text, label, base)),
grams AS (SELECT template, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT template, w, unnest(range(0, len(w) - 1)) AS p FROM t)),
votes AS (SELECT doc_id, template, p, i FROM (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM d)) JOIN grams USING (a, b)),
steps AS (SELECT doc_id, template, diag, (diag - lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag) > {licences.GAP})::INT AS apart FROM (SELECT DISTINCT doc_id, template, i - p AS diag FROM votes)),
spans AS (SELECT doc_id, template, diag, CASE WHEN base THEN diag ELSE sum(coalesce(apart, 0)) OVER (PARTITION BY doc_id, template ORDER BY diag) END AS span, label, base, len(w) AS m FROM steps JOIN t USING (template)),
placed AS MATERIALIZED (SELECT doc_id, template, span, label, base, m, p, i, 2 * m - 1 AS reach FROM spans JOIN (SELECT doc_id, template, p, i, i - p AS diag FROM votes) USING (doc_id, template, diag)),
merged AS (SELECT doc_id, template, span, label, base, m, reach, min(i) AS low, max(i) AS high FROM placed GROUP BY ALL),
starts AS (SELECT DISTINCT doc_id, template, span, i AS a, i + reach AS b FROM placed JOIN merged USING (doc_id, template, span, reach) WHERE high - low >= reach
  UNION ALL SELECT doc_id, template, span, low, high + 1 FROM merged WHERE high - low < reach),
covered AS (SELECT doc_id, template, span, a, count(DISTINCT x) AS n FROM (SELECT doc_id, template, span, a, unnest([p, p + 1]) AS x FROM starts JOIN placed USING (doc_id, template, span) WHERE i >= a AND i < b) GROUP BY ALL),
shares AS (SELECT doc_id, template, span, label, base, low, max(n) / m AS share FROM merged JOIN covered USING (doc_id, template, span) GROUP BY doc_id, template, span, label, base, low, m),
found AS (SELECT doc_id, count(*) FILTER (base AND share = 1) AS n_base, min(low) FILTER (base AND share = 1) AS first_word, max(low) FILTER (base AND share = 1) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base AND share = 1)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN share = 1 ELSE share >= {licences.COVERED} END)), ',') AS labels, max(share) AS score FROM shares GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licences.with_labels(table(spark, folder, "documents"))


@query("op6_phrase_index", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g FROM (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM b)),
grams AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT DISTINCT doc_id, s, n, item FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1),
spots AS MATERIALIZED (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
rare AS (SELECT item, t, row_number() OVER (PARTITION BY item ORDER BY cf, t) AS r FROM (SELECT DISTINCT item, unnest(w) AS t FROM b) JOIN (SELECT t, count(*) AS cf FROM spots GROUP BY 1) USING (t)),
seen AS (SELECT item, doc_id, p, r, lag(p) OVER o AS lp, lag(r) OVER o AS lr FROM spots JOIN (SELECT * FROM rare WHERE r <= 2) USING (t) WINDOW o AS (PARTITION BY item, doc_id ORDER BY p)),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM seen WHERE lr <> r AND p - lp <= 13 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN near USING (doc_id)""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return phrase_index.decontamination(docs, items, scratch_folder(spark, "postings")).drop("key")


# Host, path and verdict of the contract's rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op7_url_filter", r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, found) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, found, row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(found, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (host, path)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.with_verdicts(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op8_gray_index")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return gray_index.near_duplicates(table(spark, folder, "documents"))


@query("op9_linear_grouping")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op10_bucket_pointers")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans.removed_spans(table(spark, folder, "documents"))


@query("op11_spelling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(table(spark, folder, "documents"), damage_every=97))


@query("op12_set_sketch")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return set_sketch.near_duplicates(table(spark, folder, "documents"))


@query("op13_lexical", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS t FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, t, m, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t, 75 + (25 * len(w) * n) // l AS m FROM d, s) SEMI JOIN q USING (t) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
scores AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN v USING (t) GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) WHERE place <= 20""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "lexical")
    lexical.write_index(table(spark, folder, "documents"), path)
    return lexical.search(spark, path, table(spark, folder, "benchmark"))
