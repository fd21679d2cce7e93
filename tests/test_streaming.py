import datetime as dt
import random

from gleaner.operators import attempts
from gleaner.operators.search import keyword_search
from gleaner.streaming import jobs
from gleaner.streaming.log import KeyedLog

from .conftest import rows

T0 = dt.datetime(2024, 1, 1)


def feed_files(spark, path, schema, *batches):
    """One file per batch, in order of time."""
    import os

    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and f[0] != "b":
                os.rename(f"{path}/{f}", f"{path}/b{i}.parquet")
                os.utime(f"{path}/b{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    return jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_failures_over_batches_equal_the_batch_result(spark, tmp_path):
    rnd = random.Random(4)
    log = [(rnd.randrange(3), i, T0 + dt.timedelta(hours=i), rnd.random() < 0.25) for i in range(90)]
    schema = "feed_id long, seq long, ts timestamp, ok boolean"
    stream = feed_files(spark, str(tmp_path / "in"), schema, log[:30], log[30:60], log[60:])
    state = KeyedLog(spark, str(tmp_path / "state"), ["feed_id"], jobs.FAILURE_SCHEMA)
    jobs.start_failures(stream, state, str(tmp_path / "ckpt")).awaitTermination()
    want = attempts.feed_state(spark.createDataFrame(log, schema))
    assert rows(state.latest(), "feed_id", "failures", "longest_run") == rows(want, "feed_id", "fetch_failures", "longest_run")


def test_failures_late_rows_wait_or_are_counted(spark, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    schema = "feed_id long, seq long, ts timestamp, ok boolean"
    log = [(1, i, hour(i), i % 5 == 0) for i in range(60)]
    late_but_in_time, too_late = [r for r in log if r[1] in (37, 40)], [r for r in log if r[1] in (3, 5)]
    first = [r for r in log if r[1] < 45 and r not in late_but_in_time and r not in too_late]
    stream = feed_files(spark, str(tmp_path / "in"), schema, first, late_but_in_time + too_late + [(2, 1, None, True)], [r for r in log if r[1] >= 45])
    table = KeyedLog(spark, str(tmp_path / "state"), ["feed_id"], jobs.FAILURE_SCHEMA)
    jobs.start_failures(stream, table, str(tmp_path / "ckpt"), delay_days=1).awaitTermination()
    want = attempts.feed_state(spark.createDataFrame([r for r in log if r not in too_late], schema)).first()
    assert rows(table.latest(), "feed_id", "seq", "failures", "longest_run", "n_late") == [(1, 59, want.fetch_failures, want.longest_run, 2)]


def test_dedup_keeps_a_key_that_returns(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    schema = "id long, k string, ts timestamp"
    stream = feed_files(spark, str(tmp_path / "in"), schema, [(1, "a", day(0)), (2, "a", day(29)), (3, "a", day(30)), (4, None, day(0)), (5, None, day(1))],
                        [(6, "a", day(40)), (7, "b", day(41)), (8, "a", day(25))], [(9, "a", day(60)), (10, "b", day(41)), (11, "c", day(1))])
    table = KeyedLog(spark, str(tmp_path / "kept"), ["id"], schema)
    jobs.start_dedup(stream, ["k"], "ts", "id", table, str(tmp_path / "ckpt")).awaitTermination()
    assert rows(table.rows(), "id") == [(1,), (11,), (3,), (4,), (7,), (9,)]


def test_ingest_and_upsert_over_batches(spark, tmp_path):
    text = "a text that is long enough to be compared by its content"
    schema = "article_id long, feed_id long, source_url string, title string, content_text string, fetched_at timestamp"

    def item(i, url, body, day):
        return (i, 1, url, "t", body, T0 + dt.timedelta(days=day))

    stream = feed_files(spark, str(tmp_path / "in"), schema, [item(1, "http://a/1", text, 0), item(2, "http://a/2", text + "2", 0)],
                        [item(3, "http://a/1#x", "something else that is long enough to count", 1), item(4, "http://a/4", text, 2), item(5, "http://a/5", text, 45)])
    store = jobs.ArticleStore(spark, str(tmp_path / "store"))
    topics = spark.createDataFrame([(1, "n", "", ["long enough"], True)], "topic_id long, name string, description string, keywords array<string>, enabled boolean")
    jobs.start_ingest(stream, store, topics, str(tmp_path / "ckpt")).awaitTermination()
    assert rows(store.articles.rows(), "article_id", "status", "word_count", "batch") == [(1, "pending", 12, 0), (2, "pending", 12, 0), (5, "pending", 12, 1)]
    assert rows(store.audit.rows(), "article_id", "winner_id", "gate") == [(3, 1, "url"), (4, 1, "content")]
    assert rows(store.topics.rows(), "article_id", "topic_id") == [(1, 1), (2, 1), (5, 1)] and store.tasks.rows().count() == 6
    asked = spark.createDataFrame([(0, '"long enough" -unknown')], "query_id long, query string")
    assert rows(keyword_search(store.index(), asked, 5), "doc_id") == [(1,), (2,), (5,)]


def test_windows_count_late_rows_and_weeks_start_on_monday(spark, tmp_path):
    schema = "source string, ts timestamp"
    stream = feed_files(spark, str(tmp_path / "in"), schema, [("a", T0), ("a", T0 + dt.timedelta(days=6)), ("b", T0 + dt.timedelta(days=20))],
                        [("a", T0 + dt.timedelta(days=7)), ("b", T0 + dt.timedelta(days=21))], [("a", T0 + dt.timedelta(hours=3))])
    table = jobs.PeriodCounts(spark, str(tmp_path / "w"))
    jobs.start_windows(stream, "source", "ts", table, str(tmp_path / "ckpt"), "weekly").awaitTermination()
    got = [(str(d), s, n, late) for d, s, n, late in rows(table.counts(), "period_start", "source", "n", "n_late")]
    # after the first batch the clock stands at day 20: weeks that ended by day 18 are closed
    assert sorted(got) == [("2024-01-01", "a", 2, 1), ("2024-01-08", "a", 0, 1), ("2024-01-15", "b", 1, 0), ("2024-01-22", "b", 1, 0)]
    assert rows(table.late.rows(), "source", "ts") == sorted([("a", T0 + dt.timedelta(days=7)), ("a", T0 + dt.timedelta(hours=3))], key=repr)
