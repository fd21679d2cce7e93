import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import search
from gleaner.operators.postings import PostingIndex, write_index
from gleaner.operators.ranking import reciprocal_rank_fusion
from gleaner.operators.vector_search import nearest, recall, similar, vector_search
from gleaner.session import scratch_folder

from .conftest import rows


def index_of(spark, texts, **sizes):
    path = scratch_folder(spark, "index")
    write_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", F.col("text"), path, **sizes)
    return PostingIndex(spark, path, **{k: v for k, v in sizes.items() if k == "buckets"})


def asked(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")


TEXTS = {1: "red fox jumps", 2: "red dog sleeps near red fox", 3: "blue fox", 4: "green", 5: ""}


def hits(spark, *qs, k=10):
    found = search.keyword_search(index_of(spark, TEXTS), asked(spark, *qs), k)
    return {q: [r.doc_id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in range(len(qs))}


def test_query_syntax(spark):
    got = hits(spark, "red fox", '"red fox"', "dog or blue", "fox -red", "RED unknown", "  ", '-"red fox"', "fox")
    assert sorted(got[0]) == [1, 2] and sorted(got[1]) == [1, 2] and sorted(got[2]) == [2, 3]
    assert got[3] == [3] and got[4] == [] and got[5] == [] and got[6] == [3, 4, 5] and len(got[7]) == 3


def plain_scores(texts, query):
    """Scores by the BM25 formula for queries of words, "phrases" and -exclusions joined by or."""
    docs = {d: re.findall(r"\w+", t.lower()) for d, t in texts.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    out = {}
    for alt in re.split(r"\bor\b", query.lower()):
        items = re.findall(r'-?"[^"]*"|\S+', alt)
        for d, words in docs.items():
            has = lambda item: any(words[i:i + len(item)] == item for i in range(len(words)))
            parts = [(i.startswith("-"), re.findall(r"\w+", i), '"' in i) for i in items]
            if not parts or any(no and has(w) for no, w, _ in parts) or not all(has(w) if quoted else set(w) <= set(words) for no, w, quoted in parts if not no):
                continue
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / avgdl)) for t in {t for no, w, _ in parts if not no for t in w})
            out[d] = max(out.get(d, 0), round(s, 6))
    return out


def test_keyword_search_against_plain_scoring_in_many_segments(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["the"] * 8
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for i in range(400)}
    qs = ["the", "w1 w2", '"w1 w2"', '"the the w3"', "w1 -w2", '-"the the"', "-the -w1", "w1 or w2 -w3", "w1 -unknown", "unknown", "-unknown", 'w4 "w5 the" or "w6 w7"', "w1 w1 w1"]
    monkeypatch.setattr(search, "FIRST_SEGMENTS", 2)
    index = index_of(spark, texts, buckets=7, segment_tokens=150)
    assert index.docs().count() >= 4
    got = rows(search.keyword_search(index, asked(spark, *qs), 5), "query_id", "doc_id", "score", "rank")
    want = []
    for q, text in enumerate(qs):
        best = sorted(plain_scores(texts, text).items(), key=lambda x: (-x[1], x[0]))
        want += [(q, d, s, r + 1) for r, (d, s) in enumerate(best[:5])]
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want, key=repr)]
    every = rows(search.keyword_matches(index, asked(spark, *qs)), "query_id", "doc_id")
    assert every == sorted(((q, d) for q, text in enumerate(qs) for d in plain_scores(texts, text)), key=repr)


def test_only_asked_buckets_are_read(spark):
    index = index_of(spark, {i: f"word{i} common" for i in range(200)}, buckets=64)
    terms = spark.createDataFrame([("word7",), ("word9",)], "term string")
    plan = index.lists(terms)._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([^)]*)\)", plan) or re.search(r"PartitionFilters: \[.*?bucket#\d+ = (\d+)", plan)
    assert parts and len(parts[1].split(",")) <= 2
    assert rows(index.lists(terms), "term", "docs") == [("word7", [7]), ("word9", [9])]


def test_fusion_prefers_items_in_both_channels(spark):
    def channel(*ids):
        return spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank long")

    fused = reciprocal_rank_fusion(channel(1, 2, 3), channel(2, 3, 4), keys=["query_id"], item=["doc_id"])
    assert [r.doc_id for r in fused.orderBy("rank").collect()][:2] == [2, 3]
    many = channel(*range(100))
    assert reciprocal_rank_fusion(many, keys=["query_id"], item=["doc_id"], n=5).count() == 5


def test_nearest_against_numpy_with_ties_and_blocks(spark):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(120, 8))
    docs[50:80] = docs[50]  # ties
    qs = np.vstack([docs[50], rng.normal(size=(6, 8))])
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(docs)], "doc_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(qs) @ unit(docs).T, 6)
    want = [(q, int(d), r + 1) for q in range(7) for r, d in enumerate(sorted(range(120), key=lambda d: (-sims[q, d], d))[:5])]
    for probes, size in ((1, 2_048), (3, 7)):
        got = rows(nearest(corpus, queries, 5, probes=probes, block_rows=size), "query_id", "doc_id", "rank")
        assert got == sorted(want, key=repr)


def test_hot_cells_odd_vectors_and_the_faster_search(spark):
    """A third of all vectors equal, some without length, null, empty or of another dimension; groups with nulls."""
    rng = np.random.default_rng(1)
    docs = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)], "a" if i % 2 else None) for i in range(300)]
    docs += [(900, [0.0, 0.0, 0.0], "a"), (901, None, "a"), (902, [], None), (903, [1.0], "a"), (7, [0.0, 1.0, 0.0], "a")]
    asks = [(i, v, g) for i, v, g in docs[:40]] + [(900, [0.0, 0.0, 0.0], "a"), (950, None, "a"), (951, [2.0, 2.0], "a"), (952, [1.0, 1.0, 0.0], "nobody")]
    kind = "doc_id long, vector array<double>, g string"
    corpus, queries = spark.createDataFrame(docs, kind), spark.createDataFrame(asks, kind.replace("doc_id", "query_id"))
    want = []
    for q, v, g in asks:
        best = {}
        for d, u, h in docs:
            if v and u and len(u) == len(v) and h == g and d != q:
                size = np.linalg.norm(u) * np.linalg.norm(v)
                best[d] = max(best.get(d, -9), round(float(np.dot(u, v) / size), 6) if size else 0.0)
        want += [(q, d, r + 1) for r, d in enumerate(sorted(best, key=lambda d: (-best[d], d))[:6])]
    exact = nearest(corpus, queries, 6, group="g", exclude_self=True, probes=1, block_rows=16)
    assert rows(exact, "query_id", "doc_id", "rank") == sorted(want, key=repr)
    faster = recall(nearest(corpus, queries, 6, group="g", exclude_self=True, reach=0.3), exact).first()
    assert faster.n_exact == len(want) and 0.9 <= faster.recall <= 1
    assert nearest(corpus.limit(0), queries, 6).count() == 0 and nearest(corpus, queries.limit(0), 6).count() == 0


def test_vector_search_keeps_the_best_kind_and_the_active_model(spark):
    vec = spark.createDataFrame(
        [(9, "title", "m", [1.0, 0.0]), (9, "body", "m", [0.6, 0.8]), (1, "body", "m", [0.0, 1.0]), (2, "body", "old", [1.0, 0.0]), (3, "body", "m", [1.0])],
        "article_id long, kind string, model string, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert rows(vector_search(vec, q, 5, "m"), "doc_id", "similarity", "rank") == [(1, 0.0, 2), (9, 1.0, 1)]
    live = spark.createDataFrame([(1,)], "article_id long")
    assert rows(vector_search(vec, q, 5, "m", live), "doc_id") == [(1,)]


def test_hybrid_degrades_without_vectors(spark):
    ix = index_of(spark, TEXTS)
    got = search.search(ix, asked(spark, "red fox", " "), mode="hybrid", k=5)
    assert {r.mode for r in got.collect()} == {"keyword"} and {r.query_id for r in got.collect()} == {0}
    assert search.search(ix, asked(spark, "red"), mode="semantic").count() == 0


def test_wiki_pages_of_found_articles_are_not_repeated(spark):
    res = spark.createDataFrame([(0, 7, 0.5, 1)], "query_id long, doc_id long, score double, rank long")
    wiki = spark.createDataFrame([(0, 28, "article", 7, 1), (0, 7, "entity", 7, 2), (0, 32, "article", 8, 3)],
                                 "query_id long, page_id long, kind string, ref_id long, rank long")
    got = search.append_wiki(res, wiki, 10).orderBy("rank").collect()
    assert [(r.id, r.source) for r in got] == [(7, "article"), (7, "wiki"), (32, "wiki")]


def test_a_phrase_does_not_match_across_a_label(spark):
    index = index_of(spark, {1: "red fox\n\n## 要点\n\njumps far", 2: "red\n要点\nfox jumps"})
    got = search.keyword_search(index, asked(spark, '"fox jumps"', '"red fox"', "fox jumps"), 10)
    assert rows(got, "query_id", "doc_id") == [(0, 2), (1, 1), (2, 1), (2, 2)]


def test_substring_paths_agree(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc \u00e9\U0001F600") for _ in range(60)) for _ in range(80)] + ["", None, "ab" * 5_000, "ab" * 5_000]
    words = ["".join(rnd.choice("abc\u00e9\U0001F600") for _ in range(1 + i % 5)) for i in range(60)] + ["", None, "aba", "aba", "zzzz", "xyz"]
    hay = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)], "id long, t string, extra string")
    needles = spark.createDataFrame(list(enumerate(words)), "n long, s string")
    want = sorted(((n, i, f"k{i}") for i, t in enumerate(texts) for n, w in enumerate(words) if t and w and w in t), key=repr)
    assert len(want) > 500
    for limit, chars in ((100, 10), (0, 1_000), (0, 0)):
        assert rows(search.contains_any(hay, "id", "t", needles, "n", "s", limit=limit, keep=("extra",), chars=chars), "n", "id", "extra") == want
        for h, n in ((hay.limit(0), needles), (hay, needles.limit(0))):
            assert search.contains_any(h, "id", "t", n, "n", "s", limit=limit, chars=chars).count() == 0


def test_similar_articles_same_language_and_topic_bonus(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.3]), (4, [1.0, 0.0]), (5, [1.0, 0.0])], "article_id long, vector array<double>")
    arts = spark.createDataFrame([(1, "en", None), (2, "en", None), (3, "en", None), (4, "de", None), (5, "en", 1)], "article_id long, lang string, dedupe_of long")
    tags = spark.createDataFrame([(1, 7, 0.5), (3, 7, 1.0), (3, 8, 1.0)], "article_id long, topic_id long, score double")
    got = similar(vec, arts, tags, 5).where("article_id = 1").orderBy("rank").collect()
    assert [r.similar_id for r in got] == [3, 2]


def test_rerank_only_touches_the_head(spark):
    ranked = spark.createDataFrame([(0, d, 1.0, d) for d in range(1, 6)], "query_id long, doc_id long, score double, rank long")
    scores = spark.createDataFrame([(0, 2, 9.0), (0, 5, 99.0)], "query_id long, doc_id long, score double")
    assert [r.doc_id for r in search.rerank(ranked, scores, top=3).orderBy("rank").collect()] == [2, 1, 3, 4, 5]


def test_a_query_is_sent_once_for_every_pack_of_cells(spark, monkeypatch):
    from gleaner.operators import vector_search as V

    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(500, 16))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id long, vector array<double>")
    asks, choose = [], V._choose

    def counted(*args, **kw):
        asks.append(choose(*args, **kw))
        return asks[-1]

    monkeypatch.setattr(V, "_choose", counted)
    got = nearest(corpus, corpus.withColumnRenamed("doc_id", "query_id"), 5, exclude_self=True, block_rows=120)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sims, -9)
    assert {(r.query_id, r["rank"]): (r.doc_id, r.similarity) for r in got.collect()} == {
        (i, n + 1): (int(j), float(sims[i, j])) for i in range(500) for n, j in enumerate(np.lexsort((np.arange(500), -sims[i]))[:5])}
    assert len(asks) == 2 and sum(a.count() for a in asks) <= 500 * 5  # 22 cells in at most 5 packs


def test_index_counts_terms_inside_the_row(spark):
    from collections import Counter

    from gleaner.operators.index import build_index

    texts = {1: "b a b c", 2: "", 3: None, 4: "x", 5: "Zz zz 要点 zz"}
    docs = spark.createDataFrame([(i, "", t) for i, t in texts.items()], "article_id long, title string, content_text string")
    built = build_index(docs)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.dl, r.terms, r.token_text) for r in built.collect()}
    words = {1: ["b", "a", "b", "c"], 2: [], 3: [], 4: ["x"], 5: ["zz", "zz", "要", "点", "要点", "zz"]}
    assert got == {i: (len(w), dict(Counter(w)), " ".join(w)) for i, w in words.items()}


def test_vector_search_evaluates_its_corpus_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    data = spark.createDataFrame([(i, "active", [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(50)], "id long, model string, vector array<float>")
    corpus = data.select(counted.asNondeterministic()("id").alias("article_id"), "model", "vector")
    got = vector_search(corpus, data.where("id < 3").select(F.col("id").alias("query_id"), "vector"), 2, "active").collect()
    assert len(got) == 6 and seen.value == 50


def test_topics_are_found_without_moving_texts(spark):
    from gleaner.plans import base

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = base.article_topics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the join with the events stands above the aggregate of the hits, which has no text
    assert plan.index("Join LeftSemi") < plan.index("Aggregate") < plan.index("text#")


def test_mentions_summaries_and_pages_move_no_texts(spark):
    from gleaner.plans import base

    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = base.summaries(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        ranked = spark.createDataFrame([(1, i, 1.0, i + 1) for i in range(15)], "query_id long, doc_id long, score double, rank long")
        page = search.page(ranked, base.texts(spark, sf), 2, 10)
        shuffles = page._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = sorted(r.doc_id for r in page.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # sentences are cut below the join with the events, and a page is sent to the texts
    assert told.index("LeftSemi") < told.index("regexp_replace(text")
    assert shuffles == 0 and got == [10, 11, 12, 13, 14]
