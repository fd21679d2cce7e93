"""Work that must not be done twice, and what is shuffled."""

from pyspark.sql import functions as F

from .conftest import rows


def test_feed_entries_are_parsed_once(spark):
    from gleaner.sources.payloads import parse_feed

    good = "<item><title>T</title><link>http://x/1</link><description>&lt;b&gt;x&lt;/b&gt;</description></item>"
    df = spark.createDataFrame([(1, good), (2, "<item><title>no link</title></item>"), (3, "broken <"), (4, None)], "feed_id long, xml string")
    items = parse_feed(df, "xml")
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("XmlToStructs") == 1
    assert rows(items, "feed_id", "source_url", "title", "content_text") == [(1, "http://x/1", "T", "x")]


def test_landed_rows_are_worked_out_once(spark):
    from gleaner.plans import stream_queries as sq

    seen, landed = spark.sparkContext.accumulator(0), []

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    class Done:
        def awaitTermination(self):
            pass

    def start(stream):
        q = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
        q.awaitTermination()
        landed.append(rows(spark.read.schema("id long").parquet(out)))
        return Done()

    from gleaner.session import scratch_folder
    ckpt, out = scratch_folder(spark, "ckpt"), scratch_folder(spark, "out")
    df = spark.range(9).select(counted.asNondeterministic()("id").alias("id"))
    sq._in_parts(spark, df, F.col("id") % 3, start)
    assert landed == [[(0,), (3,), (6,)], [(i,) for i in (0, 1, 3, 4, 6, 7)], [(i,) for i in range(9)]]
    assert seen.value == 9


def test_posting_lists_are_not_shuffled(spark):
    from gleaner.operators.postings import PostingIndex, write_index
    from gleaner.operators.search import keyword_search
    from gleaner.session import scratch_folder

    texts = ["a b a c a b", "b a", "a c b", "c", "", "b c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2, "id")
    path = scratch_folder(spark, "index")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("write-index", "")
    try:
        write_index(df, "id", F.col("text"), path, segment_tokens=4)
        jobs = tracker.getJobIdsForGroup("write-index")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one exchange, that of the input above
    assert len({s for j in jobs for s in tracker.getJobInfo(j).stageIds}) <= 3
    index = PostingIndex(spark, path)
    held = index._read().where("term is not null").select("docs", "tfs", "ends", "places", "term").collect()
    for r in held:
        at = 0
        for doc, tf, end in zip(r.docs, r.tfs, r.ends):
            assert end == at + tf
            words = texts[doc].split()
            assert r.places[at:end] == [i for i, w in enumerate(words) if w == r.term]
            at = end
        assert at == len(r.places)
    found = keyword_search(index, spark.createDataFrame([(1, '"b a"'), (2, '"a b"'), (3, "c -b")], "query_id long, query string"), 5)
    assert rows(found, "query_id", "doc_id") == [(1, 0), (1, 1), (2, 0), (2, 5), (3, 3)]


def test_languages_shuffle_rare_tokens_only(spark, monkeypatch):
    from gleaner.operators import enrich

    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und der kater"), ("fr", "le chat et le chien der")], "lang string, text string")
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "der kater und der hund"), (3, "le chien et le chat"), (4, "xyz xyz xyz"), (5, "the"), (6, " " * 70 + "the dog and the cat"), (7, None)], "id long, t string")
    want = [(1, "en"), (2, "de"), (3, "fr"), (4, "unknown"), (5, "unknown"), (6, "en"), (7, "unknown")]
    p, sent, cut = enrich.language_profiles(docs), [], enrich.cut_lineage
    monkeypatch.setattr(enrich, "cut_lineage", lambda d: sent.append(cut(d)) or sent[-1])
    assert rows(enrich.detect_language(df, "id", "t", p)) == want
    assert rows(sent[-1].where("rare is not null"), "id", "rare") == [(4, "xyz")]
    monkeypatch.setattr(enrich, "COMMON_TOKENS", 2)
    assert rows(enrich.detect_language(df, "id", "t", p)) == want
    monkeypatch.setattr(enrich, "LANGUAGES", 1)
    assert rows(enrich.detect_language(df, "id", "t", p)) == want


def test_summaries_cut_a_text_once(spark):
    from gleaner.plans import base

    sf = "/root/testdata/sf0.001"
    for arts in (None, base.raw_articles(spark, sf)):
        plan = base.summaries(spark, sf, arts)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
