import datetime as dt
import random

from pyspark.sql import functions as F

from gleaner.operators import attempts, enrich, listings, reports, tables
from gleaner.sources import payloads, sinks

from .conftest import rows

T0 = dt.datetime(2024, 1, 1)


def test_guarded_upsert_refuses_stale_content(spark):
    arts = spark.createDataFrame([(1, "new"), (2, "b")], "article_id long, content_hash string")
    old = spark.createDataFrame([(1, "old", "v1")], "article_id long, content_hash string, v string")
    stale = spark.createDataFrame([(1, "old", "v2"), (2, "x", "v1")], "article_id long, content_hash string, v string")
    assert rows(tables.upsert_guarded(old, stale, arts, ["article_id"]), "article_id", "v") == [(1, "v1"), (2, "v1")]
    fresh = spark.createDataFrame([(1, "new", "v3")], "article_id long, content_hash string, v string")
    assert rows(tables.upsert_guarded(old, fresh, arts, ["article_id"]), "article_id", "v") == [(1, "v3")]


def test_integrity_checks_count_violations(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, s string")
    b = spark.createDataFrame([(1,), (9,), (None,)], "id long")
    got = dict(rows(tables.violations(tables.duplicates(a, ["id"], "a"), tables.orphans(b, "id", a, "id", "b"), tables.outside(a, F.col("s") != "z", "s"))))
    assert got == {"unique:a": 1, "fk:b": 1, "check:s": 1}


def test_streaks_and_outcomes_against_a_loop(spark):
    rnd = random.Random(2)
    kinds = ["queued", "timeout", "transient", "permanent", "succeeded"]
    data, t = [], T0
    for seq in range(400):
        t += dt.timedelta(hours=rnd.randrange(0, 5))
        data.append((rnd.randrange(2), "x", seq, t, rnd.choices(kinds, [1, 6, 1, 2, 1])[0]))
    df = spark.createDataFrame(data, "article_id long, task string, seq long, ts timestamp, outcome string")
    want, state = [], {}
    for a, task, seq, _, kind in data:
        s = state.setdefault(a, {"job": 0, "spent": 0, "run": 0, "dead": False})
        if kind == "queued":
            s.update(job=s["job"] + 1, spent=0, run=0, dead=False)
        s["spent"] += kind == "permanent"
        s["run"] = s["run"] + 1 if kind == "timeout" else 0
        verdict = "ignored" if s["dead"] else "dead" if s["spent"] >= 3 or s["run"] >= 3 else (
            "retry" if kind in ("timeout", "transient", "permanent") else kind)
        s["dead"] = s["dead"] or verdict == "dead"
        want.append((a, seq, s["job"], s["spent"], s["run"], verdict))
    got = rows(attempts.outcomes(df), "article_id", "seq", "job", "spent", "timeouts", "verdict")
    assert got == sorted(want, key=repr) and {w[5] for w in want} >= {"dead", "ignored", "retry"}


def test_feed_state(spark):
    log = [(1, i, T0 + dt.timedelta(days=i), i < 2) for i in range(8)] + [(2, 20 + i, T0 + dt.timedelta(days=i), i == 6) for i in range(7)] + [(3, 40, T0, False)]
    got = {r.feed_id: r for r in attempts.feed_state(spark.createDataFrame(log, "feed_id long, seq long, ts timestamp, ok boolean")).collect()}
    assert (got[1].state, got[1].fetch_failures, got[1].disabled_at_seq) == ("disabled", 6, 6)
    assert (got[2].state, got[2].longest_run) == ("healthy", 6) and got[3].state == "degraded"


def test_job_tables(spark):
    s = spark.createDataFrame([(1, "translate", "queued", T0), (2, "wiki", "queued", T0), (3, "wiki", "succeeded", T0), (4, "x", "superseded", T0)],
                              "article_id long, task string, status string, ts timestamp")
    a = spark.createDataFrame([(i, "processing", f"h{i}", None) for i in (1, 2, 3)] + [(5, "pending", "h5", None), (6, "pending", "h6", 5), (1, "pending", "h", None)],
                              "article_id long, status string, content_hash string, dedupe_of long")
    assert rows(attempts.finished(a, s), "article_id") == [(1,), (3,)]
    assert rows(attempts.unstarted(a, s), "article_id", "task") == [(5, "embed_core"), (5, "summarize")]
    assert rows(attempts.prune(s, "2024-01-01 02:00:00"), "article_id") == [(1,), (2,), (3,)]
    assert rows(attempts.prune(s, "2024-01-02 02:00:00"), "article_id") == [(1,), (2,)]
    b = spark.createDataFrame([(1, "w", [3, 1]), (1, "w", [1, 2])], "article_id long, task string, ids array<long>")
    assert rows(attempts.merge_payloads(b), "ids") == [([1, 2, 3],)]


def test_listing_by_feed_name_query_and_page(spark):
    from gleaner.operators.index import write_article_index
    from gleaner.session import scratch_folder

    a = spark.createDataFrame([(i, "t", "red fox" if i % 2 else "dog", "done", "en", T0, T0 + dt.timedelta(days=i), i % 3, None) for i in range(12)],
                              "article_id long, title string, content_text string, status string, lang string, published_at timestamp, fetched_at timestamp, feed_id long, dedupe_of long")
    feeds = spark.createDataFrame([(0, "zero"), (1, "one")], "feed_id long, name string")
    ix = write_article_index(a, scratch_folder(spark, "index"))
    assert [r.article_id for r in listings.list_articles(a, feeds, feed="one", size=3).collect()] == [10, 7, 4]
    assert [r.article_id for r in listings.list_articles(a, feeds, feed=0, index=ix, q="fox", size=1, page=2).collect()] == [3]


def test_model_outputs(spark):
    raw = {1: '{"a": 1, "b": 2,}', 2: "{'key': 'value'}", 3: "[1, 2]", 4: "no json", 5: '<think>{"x":1}</think> ok ```json\n{"a": {"b": [1]}}\n```', 6: '{"a": "x\ny"}', 7: "", 8: 'Sure [1]: {"a": 1}', 9: '{"a": True, "b": [None, "True"]}', 10: 'It is {x} so {"a": 1, "b": 2}', 11: "{{{", 12: None}
    df = spark.createDataFrame(list(raw.items()), "id long, raw string")
    good, bad = enrich.parse_outputs(df, "raw", ["a", "b"])
    assert rows(good.select("id", F.to_json("parsed").alias("j"), F.array_join("missing_keys", ",").alias("m"))) == sorted([
        (1, '{"a":1,"b":2}', ""), (2, '{"key":"value"}', "a,b"), (5, '{"a":{"b":[1]}}', "b"), (6, '{"a":"x\\ny"}', "b"),
        (8, '{"a":1}', "b"), (9, '{"a":true,"b":[null,"True"]}', ""), (10, '{"a":1,"b":2}', "")], key=repr)
    assert rows(bad, "id", "reason") == sorted([(3, "not an object"), (4, "unparseable"), (7, "unparseable"), (11, "unparseable"), (12, "unparseable")], key=repr)


def test_language(spark):
    docs = spark.createDataFrame([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 3, "text string, lang string")
    p = enrich.language_profiles(docs)
    df = spark.createDataFrame([(1, "the dog and a cat here"), (2, "die katze und der hund"), (3, "the dog"), (4, "xxxx yyyy zzzz"), (5, None)], "id long, t string")
    assert rows(enrich.detect_language(df, "id", "t", p)) == [(1, "en"), (2, "de"), (3, "unknown"), (4, "unknown"), (5, "unknown")]


def test_text_vectors_are_unit_and_equal_for_equal_text(spark):
    from gleaner.functions.vectors import cosine, norm

    df = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue dog")], "id long, t string")
    v = enrich.text_vectors(df, "id", "t", 64)
    assert all(abs(r.n - 1) < 1e-5 for r in v.select(norm(F.col("vector")).alias("n")).collect())
    a, b = v.alias("a"), v.alias("b")
    same = a.join(b, F.col("a.id") == F.col("b.id") - 1).where("a.id = 1").select(cosine(F.col("a.vector"), F.col("b.vector")).alias("c")).first().c
    assert abs(same - 1) < 1e-6


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<?xml version="1.0"?><rss xmlns:content="c" xmlns:dc="d"><channel><title>ch</title>
<item><title> One </title><link>http://a/1</link><description>&lt;b&gt;bold&lt;/b&gt; text</description><content:encoded>&lt;p&gt;x&lt;/p&gt;</content:encoded>
<dc:creator>Ann</dc:creator><pubDate>Tue, 02 Jan 2024 03:04:05 +0200</pubDate></item><item><title>No link</title></item></channel></rss>""")
    got = payloads.read_feed(spark, str(tmp_path / "f.xml"), 5).collect()
    assert [(r.feed_id, r.source_url, r.title, r.content_text, r.content_html, r.author, str(r.published_at)) for r in got] == [
        (5, "http://a/1", "One", "bold text", "<p>x</p>", "Ann", "2024-01-02 01:04:05")]
    (tmp_path / "a.xml").write_text("""<feed><entry><title>Two</title><link href="http://a/2"/><summary>short</summary><author><name>Bo</name></author>
<published>2024-01-02T03:04:05Z</published></entry></feed>""")
    got = payloads.read_feed(spark, str(tmp_path / "a.xml"), 6, "entry").collect()
    assert [(r.source_url, r.content_text, r.author, str(r.published_at)) for r in got] == [("http://a/2", "short", "Bo", "2024-01-02 03:04:05")]


def test_api_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"hits": [{"title": "T", "u": "", "alt": "http://x", "time": 1704164645, "m": {"c": "body"}}, {"id": 7, "time": "2024-01-02T03:04:05Z"}, 5, {}]}')
    got = payloads.read_api(spark, str(tmp_path / "a.json"), {"url": ["u", "alt"], "content": "m.c"}, "$.hits")
    assert rows(got.withColumn("published_at", F.col("published_at").cast("string"))) == [
        ("(no title)", "(no title)", "", "", None), ("7", "(no title)", "", "", "2024-01-02 03:04:05"), ("http://x", "T", "body", "", "2024-01-02 03:04:05")]


def test_feed_limits_and_unchanged_payloads(spark):
    items = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "feed_id long, item_no long")
    kept, dropped = payloads.limit_per_feed(items, 3)
    assert rows(kept) == [(1, 0), (1, 1), (1, 2), (2, 0)] and rows(dropped) == [(1, 2)]
    seen = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "url string, body string, seq long")
    new = spark.createDataFrame([("u", "b "), ("u", "a"), ("v", "b")], "url string, body string")
    assert rows(payloads.skip_unchanged(new, seen), "url", "body") == [("u", "a"), ("v", "b")]


def test_audit_log_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_events(spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=100))], "id long, created_at timestamp"), path)
    sinks.append_events(spark.createDataFrame([(3, T0)], "id long, created_at timestamp"), path)
    assert rows(spark.read.parquet(path), "id") == [(1,), (2,), (3,)]
    assert sinks.drop_expired(spark, path, "2024-04-15") == ["event_date=2024-01-01"]
    assert rows(spark.read.parquet(path), "id") == [(2,)]


def test_growth_keeps_what_has_gone(spark):
    week = lambda n: T0 + dt.timedelta(days=7 * n)
    arts = spark.createDataFrame([(1, week(0), None), (2, week(0), None), (3, week(2), None)], "article_id long, fetched_at timestamp, dedupe_of long")
    tags = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "article_id long, topic_id long")
    names = spark.createDataFrame([(1, "A"), (2, "B")], "topic_id long, name string")
    seen = spark.createDataFrame([(week(0),), (week(2),)], "first_seen timestamp")
    got = rows(reports.growth(arts, tags, names, seen, seen.limit(0)).select(F.col("week").cast("string"), "measure", "name", "n", "previous"))
    first, second, third = (str(week(n).date()) for n in range(3))
    assert got == sorted([(first, "topic", "A", 1, 0), (first, "topic", "B", 1, 0), (second, "topic", "A", 0, 1), (second, "topic", "B", 0, 1), (third, "topic", "B", 1, 0),
                          (first, "entities_new", "", 1, 0), (second, "entities_new", "", 0, 1), (third, "entities_new", "", 1, 0)], key=repr)


def test_guarded_upsert_with_null_keys_and_lists_without_an_index(spark):
    arts = spark.createDataFrame([(1, "now"), (2, "now")], "article_id long, content_hash string")
    kind = "article_id long, lang string, content_hash string, v string"
    old = spark.createDataFrame([(1, None, "x", "old"), (2, "en", "x", "old")], kind)
    new = spark.createDataFrame([(1, None, "now", "new"), (2, "en", "stale", "new"), (None, "de", "any", "new")], kind)
    assert rows(tables.upsert_guarded(old, new, arts, ["article_id", "lang"]), "article_id", "v") == sorted([(1, "new"), (2, "old"), (None, "new")], key=repr)
    listed = spark.createDataFrame([(1, "Red fox", "x", None), (2, "t", "a FOX", None), (3, "t", "dog", None)], "article_id long, title string, content_text string, dedupe_of long")
    listed = listed.withColumns({"status": F.lit("done"), "lang": F.lit("en"), "published_at": F.lit(T0), "feed_id": F.lit(1), "fetched_at": F.lit(T0)})
    assert [r.article_id for r in listings.list_articles(listed, q="fox").collect()] == [1, 2]
