"""Texts are cut, compared and sent no more often than needed."""

import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import text as X

from .conftest import rows

CUT = "[.!?"  # the pattern that ends sentences


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_told_apart_and_single_blanks_stay(spark):
    old = (r"[^!-\x7F\u00A1-\u167F\x00-\x08\x0E-\x1B\x80-\x84\x86-\x9F\u1681-\u1FFF\u200B-\u2027\u202A-\u202E"
           r"\u2030-\u205E\u2060-\u2FFF\u3001-\x{10FFFF}]")
    cjk = r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uAC00-\uD7AF]"
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([("".join(chars[i:i + 4096]),) for i in range(0, len(chars), 4096)], "t string")
    odd = [F.regexp_extract_all("t", F.lit(new), F.lit(0)) != F.regexp_extract_all("t", F.lit(before), F.lit(0))
           for new, before in ((X.BLANK, old), (X.CJK, cjk), (f"[^ {X.ODD_BLANKS}]", f"(?!{old})(?s:.)"))]
    assert df.where(odd[0] | odd[1] | odd[2]).isEmpty()
    runs = ["", " ", "\n", "a b", "a  b", "a\nb", "a \nb", "a\n b", "\u00A0a\t\tb \u2003", "  a   b\u3000c ", "a\u200Bb", " \n "]
    t = spark.createDataFrame([(r,) for r in runs], "t string")
    assert t.where(X.squash(F.col("t")) != F.trim(F.regexp_replace("t", old + "+", " "))).isEmpty()
    assert spark.range(1).select(F.regexp_count(F.lit("one two three"), F.lit(X.RUN))).first()[0] == 0


def test_only_words_that_begin_an_alias_are_put_together(spark):
    from gleaner.operators.entities import extract_entities

    docs = spark.createDataFrame([(1, "New York  City. New\u00A0York! york new"), (2, " . \u3000\n new"), (3, None), (4, "")], "article_id long, content_text string")
    known = spark.createDataFrame([("new york", "NY", "l"), ("new york", "NY2", "l"), ("new york city", "NYC", "l"), ("new", "New", "x"), ("york", "York", "l"), ("", "e", "x"),
                                   (None, "n", "x"), ("new  york", "d", "x"), ("york new city", "z", "x")], "alias string, name string, type string")
    every = ("article_id", "sentence", "pos", "name", "type", "surface", "confidence")
    small = extract_entities(docs, known)
    assert "arrays_zip" not in optimized(small)
    for most in (None, 1, 2):
        assert rows(extract_entities(docs, known, most), *every) == rows(extract_entities(docs, known, most, rows=0), *every) != []
    assert rows(small, "article_id", "sentence", "pos", "name") == sorted([
        (1, 0, 1, "New"), (1, 0, 1, "NY"), (1, 0, 1, "NY2"), (1, 0, 1, "NYC"), (1, 0, 2, "York"), (1, 1, 1, "New"), (1, 1, 1, "NY"), (1, 1, 1, "NY2"), (1, 1, 2, "York"),
        (1, 2, 1, "York"), (1, 2, 2, "New"), (2, 1, 1, "New")], key=repr)


def test_details_cut_no_text_again(spark):
    from gleaner.plans.catalog import QUERIES

    assert optimized(QUERIES["article_detail"](spark, "/root/testdata/sf0.001")).count(CUT) == 0


def test_tokens_of_sentences_are_counted_by_batch(spark):
    from gleaner.operators import enrich

    from .test_summary import TEXTS, expected

    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((r.doc_id, r.summary_text, r.key_points, round(r.confidence, 4)) for r in enrich.summarize(df, "doc_id", "text").collect())
        batches = [pa.record_batch([pa.array([1, 2, 3]), pa.array([0, 0, 1]), pa.array([["a", "b"], [], ["b", "c"]])], ["key", "pos", "tokens"])]
        counted, weighed = next(enrich._counted(iter(batches))), next(enrich._weighed(iter(batches), {"a": 1.0, "b": 2.0}))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(TEXTS)
    assert sorted(map(tuple, zip(*counted.to_pydict().values()))) == [("a", 1), ("b", 2), ("c", 1)]
    assert weighed.select(["key", "pos", "rare", "n"]).to_pylist() == [
        {"key": 1, "pos": 0, "rare": None, "n": 2}, {"key": 3, "pos": 1, "rare": None, "n": 1}, {"key": 3, "pos": 1, "rare": "c", "n": 1}]
    assert weighed.column("w").to_pylist()[:2] == [3.0, 2.0]


def test_articles_with_equal_entities_are_not_paired(spark, monkeypatch):
    from gleaner.operators import related

    ranked, n = [], 120
    plain = related.top_per_group
    monkeypatch.setattr(related, "top_per_group", lambda df, *rest: ranked.append(df.count()) or plain(df, *rest))
    arts = spark.range(n).select(F.col("id").alias("article_id"), F.timestamp_seconds("id").alias("published_at"), F.lit(None).cast("long").alias("dedupe_of"))
    links = arts.select("article_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2) + F.col("article_id") % 2)).alias("entity_id"))
    for hot in (2_000, 100):
        got = rows(related.related_entity(arts, links, hot=hot), "article_id", "related_id", "shared", "rank")
        want = [(a, b, 2, r + 1) for a in range(n) for r, b in enumerate([b for b in range(n - 1, -1, -1) if (a - b) % 2 == 0 and a != b][:5])]
        assert got == sorted(want, key=repr)
    assert max(ranked) <= n * 12  # not n * n
