"""Cases that the queries over the given tables do not reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.operators import attempts, dedup, enrich, entities, tables, vector_search
from gleaner.streaming.log import KeyedLog

from .conftest import rows


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_one_new_row_per_key_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "x"), (2, "y"), (None, "m"), (None, "o")], "k long, v string")
    assert rows(tables.upsert_latest(old, new, ["k"])) == [(1, "c"), (2, "y"), (None, "o")]
    assert rows(tables.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "x"), (None, "n")]
    assert rows(tables.upsert_latest(old.select("k"), new.select("k"), ["k"])) == [(1,), (2,), (None,)]


def test_later_batch_with_earlier_change(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], "k long, seq long")
    log.write(spark.createDataFrame([(1, 9)], "k long, seq long"), 0)
    log.write(spark.createDataFrame([(1, 2)], "k long, seq long"), 1)
    assert rows(log.latest(["seq"])) == [(1, 9)]


@pytest.mark.parametrize("ts", [[day(5), day(1), day(3)], [day(1), None, day(2)]])
def test_streaks_follow_the_order_column(spark, ts):
    log = spark.createDataFrame([("f", 1, ts[0], False), ("f", 2, ts[1], True), ("f", 3, ts[2], False)], "feed_id string, seq long, ts timestamp, ok boolean")
    assert rows(attempts.feed_state(log), "fetch_failures", "longest_run") == [(1, 1)]
    far = spark.createDataFrame([("f", i * 3000, day(-i), False) for i in range(8)], "feed_id string, seq long, ts timestamp, ok boolean")
    assert rows(attempts.feed_state(far), "fetch_failures", "longest_run", "disabled_at_seq") == [(8, 8, 12000)]


def test_stored_copies_win_whatever_the_time(spark):
    text, schema = "a text that is long enough to be compared with others", "article_id long, feed_id long, source_url string, content_text string, fetched_at timestamp"

    def run(new, old):
        fresh = spark.createDataFrame([(i, 1, f"http://x/{i}", text, day(d)) for i, d in new], schema)
        held = spark.createDataFrame([(i, 1, f"http://x/{i}", text, day(d), loser) for i, d, loser in old], schema + ", dedupe_of long")
        inserted, hits = dedup.exact_dedup(fresh, held)
        return rows(inserted, "article_id"), rows(hits, "article_id", "winner_id", "gate")

    assert run([(10, 0)], [(1, 5, None)]) == ([], [(10, 1, "content")])
    assert run([(10, 36)], [(1, 1, None), (2, 21, None)]) == ([], [(10, 2, "content")])
    assert run([(10, 36), (11, 37)], [(1, 1, None), (2, 21, 1)]) == ([(10,)], [(11, 10, "content")])
    assert run([(10, 0), (11, 100), (12, 101)], []) == ([(10,), (11,)], [(12, 11, "content")])


def test_repeated_urls(spark):
    schema = "article_id long, feed_id long, source_url string, content_text string, fetched_at timestamp"
    fresh = spark.createDataFrame([(10, 1, "http://x/a", "t", day(0)), (11, 1, "HTTP://X/a#f", "u", day(1)), (12, 1, "http://x/b", "v", day(2))], schema)
    held = spark.createDataFrame([(1, 1, "http://x/b", "w", day(9), None)], schema + ", dedupe_of long")
    inserted, hits = dedup.exact_dedup(fresh, held)
    assert rows(inserted, "article_id") == [(10,)] and rows(hits, "article_id", "winner_id", "gate") == [(11, 10, "url"), (12, 1, "url")]


def test_long_aliases_and_ids(spark):
    docs = spark.createDataFrame([(1, "We met the bank of new york today.")], "article_id long, content_text string")
    known = spark.createDataFrame([("bank of new york", "BNY", "org"), ("york", "York", "place")], "alias string, name string, type string")
    assert rows(entities.extract_entities(docs, known), "name", "pos") == [("BNY", 4), ("York", 7)]
    ids = spark.createDataFrame([("a:b", "c"), ("a", "b:c")], "k string, n string").select(entities.entity_id(F.col("k"), F.col("n")))
    assert ids.distinct().count() == 2


def test_many_vectors_per_document_and_several_dimensions(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.01 * i]) for i in range(5)] + [(2, [0.5, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [])], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, None)], "query_id long, vector array<double>")
    assert rows(vector_search.nearest(corpus, asked, 2), "query_id", "doc_id", "rank") == [(7, 1, 1), (7, 2, 2), (8, 3, 1)]


@pytest.mark.parametrize("raw, want", [
    ("<think>{no}</think>Here: {'a': 'it''s', 'b': [1, 2,],}", None),
    ("{'a': 'x', 'b': [1, 2,],}", '{"a":"x","b":[1,2]}'),
    ("```json\n{\"a\": \"it's, {so}\",\n \"b\": 'line\nbreak',}\n``` done }", '{"a":"it\'s, {so}","b":"line\\nbreak"}'),
    ("{'a': 'say \"hi\"'}", '{"a":"say \\"hi\\""}'),
    ("[1, 2]", None), ("no json", None), (None, None),
])
def test_outputs_with_several_faults(spark, raw, want):
    good, bad = enrich.parse_outputs(spark.createDataFrame([(raw,)], "raw string"), "raw", ["a", "z"])
    if want is None:
        assert bad.count() == 1 or good.count() == 1
    else:
        assert [(r.j, r.missing_keys) for r in good.select(F.to_json("parsed").alias("j"), "missing_keys").collect()] == [(want, ["z"])]
