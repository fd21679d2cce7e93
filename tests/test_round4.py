"""Findings of the fourth round."""

import datetime
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import dedup, entities as ent
from gleaner.operators.index import build_index
from gleaner.session import cut_lineage

from .conftest import rows
from .test_corpus import levenshtein


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_names_do_not_come_to_the_driver(spark):
    names = [f"name{i % 40} word{i // 40}" for i in range(400)]
    e = spark.createDataFrame([(i, "t", n, [f"also {n}"]) for i, n in enumerate(names)], "entity_id long, type string, name string, aliases array<string>")
    # from files, as a table is: their size says nothing about the combinations of trigrams that are made of them
    stored = cut_lineage(e)
    sets = cut_lineage(stored.select("entity_id", "type", F.array_sort(ent.trigrams(F.col("name"))).alias("g")))
    assert "Broadcast" not in plan(ent._candidates(sets, 0.6)) and "Broadcast" not in plan(ent._similar_sets(sets, 0.6))
    assert "Broadcast" not in plan(ent.alias_pairs(stored))
    assert rows(ent.alias_pairs(stored)) == rows(ent.alias_pairs(e))


def test_grounding_counts_the_edits_of_the_sql(spark, tmp_path):
    import duckdb

    from gleaner.plans.corpus_queries import entity_ground
    from gleaner.plans.catalog import ORACLES

    rnd = random.Random(3)
    # in every third text '~' + the word's tail + '~' is looked for: a letter of two bytes beside it costs two edits
    words = [(2, "ladoasosci\u00f3"), (5, "ladoasosci\u00f3 and xadoasoscix"), (8, "ladoasosci"), (11, "ladoasosci.")]
    texts = words + [(i, " ".join("".join(rnd.choice("abn\u00e9\u00fc\u4e09\U0001F600") for _ in range(rnd.randrange(5, 12))) for _ in range(12)) + " naabanna bbanaaba")
                     for i in range(12, 120)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["entity_ground"]).fetchall(), key=repr)
    assert rows(entity_ground(spark, str(tmp_path)), "article_id", "surface", "grounded", "confidence") == want
    assert sum(r[2] for r in want) > 20
    assert {r[0]: r[2] for r in want if r[0] < 12} == {2: False, 5: True, 8: False, 11: True}


def test_no_byte_edits_touch_more_characters():
    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab\u00e9\u00e8\u00c3\u4e09\u4e08\U0001F600\U0001F601") for _ in range(rnd.randrange(0, 7))) for _ in "ab")
        assert levenshtein(a, b) <= levenshtein(a.encode(), b.encode())


def near_texts(rnd, n, vocab=60):
    """Texts of a few families: most are copies or near copies of another."""
    base = [[rnd.choice([f"w{i}" for i in range(vocab)]) for _ in range(40)] for _ in range(6)]
    out = []
    for _ in range(n):
        c = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 0, 1, 2))):
            c[rnd.randrange(len(c))] = f"w{rnd.randrange(vocab)}"
        rnd.shuffle(c)
        out.append(c)
    return out


def near_brute(texts, langs, at, threshold, days, k):
    counts = [Counter(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    vecs = []
    for c in counts:
        v = {w: (1 + math.log(n)) * math.log(1 + len(texts) / df[w]) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({w: x / length for w, x in v.items()})
    want = []
    for i in range(len(texts)):
        near = []
        for j in range(len(texts)):
            if langs[i] is not None and langs[i] == langs[j] and (at[j], j) < (at[i], i) and at[i] - at[j] < days:
                s = 1.0 if counts[i] == counts[j] else round(sum(x * vecs[j].get(w, 0) for w, x in vecs[i].items()), 6)
                if s >= threshold:
                    near.append((-s, at[j], j))
        want += [(i, j, r + 1) for r, (_, _, j) in enumerate(sorted(near)[:k])]
    return sorted(want, key=repr)


def near_articles(spark, texts, langs, at):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(i, None, "", " ".join(t), langs[i], start + datetime.timedelta(days=at[i])) for i, t in enumerate(texts)],
                                 "article_id long, dedupe_of long, title string, content_text string, lang string, fetched_at timestamp")


def test_copies_have_neighbours_and_are_neighbours(spark):
    rnd = random.Random(12)
    texts = near_texts(rnd, 90)
    langs = [rnd.choice(("en", "en", "en", "de", None)) for _ in texts]
    for days, step in ((30, 0.1), (10, 0.8), (3, 0.25)):  # all in one window, and copies that go on for many of them
        at = [rnd.choice((i, i, i + 0.5, max(0, i - 3))) * step for i in range(len(texts))]
        a = near_articles(spark, texts, langs, at)
        want = near_brute(texts, langs, at, 0.8, days, None)
        got = rows(dedup.near_pairs(build_index(a), a, 0.8, days, None, chained=False), "article_id", "neighbour_id", "rank")
        assert got == want and len(want) > 50
    assert rows(dedup.near_pairs(build_index(a), a, 0.8, days, 3, chained=False), "article_id", "neighbour_id", "rank") == [r for r in want if r[2] <= 3]
    members = spark.createDataFrame([(i % 2, i, i * 5) for i in range(60)], "grp long, doc_id long, t long")
    links = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.9), (1, 0, 0.9)], "gx long, gy long, similarity double")
    dealt = rows(dedup._members_of(links, members, 100, 7), "a", "b")
    assert dealt == rows(dedup._members_of(links, members, 100), "a", "b") == sorted(
        ((a, b) for a in range(60) for b in range(a) if a - b < 20 and not a % 2 == b % 2 == 1), key=repr)


def test_near_dup_pairs_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from gleaner.plans.catalog import ORACLES, QUERIES

    rnd = random.Random(13)
    texts = [" ".join(t) for t in near_texts(rnd, 120, 400)]
    texts += [t.upper() for t in texts[:20]] + ["...", "--"]  # copies of other bytes, and two texts without a word
    spark.createDataFrame([(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    spark.createDataFrame([(i, start + datetime.timedelta(hours=rnd.randrange(24 * 50)), "click") for i in range(len(texts))],
                          "event_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["near_dup_pairs"]).fetchall(), key=repr)
    got = rows(QUERIES["near_dup_pairs"](spark, str(tmp_path)), "article_id", "neighbour_id", "similarity", "rank")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    # more than one pair for a copy, copies as neighbours, and more than ten pairs of one article
    assert max(r[3] for r in want if r[2] == 1.0) > 1 and {r[1] for r in want} & {r[0] for r in want} and max(r[3] for r in want) > 10


def test_rarer_terms_and_split_cells_give_the_same_pairs(spark):
    rnd = random.Random(14)
    texts = near_texts(rnd, 80)
    at, langs = [i * 0.1 for i in range(80)], ["en"] * 80
    a = near_articles(spark, texts, langs, at)
    counts = cut_lineage(build_index(a))
    frequencies = dedup.document_frequencies(counts)
    flat = lambda known: {r.doc_id: [(e.h, round(e.w, 9), round(e.rest, 9)) for e in r.p] for r in dedup._prefixes(counts, frequencies, 80, 0.2, known).collect()}
    assert flat(0) == flat(20) == flat(1000) and max(map(len, flat(20).values())) > 3
    vectors = dedup.tfidf_vectors(counts, frequencies).select("doc_id", F.transform("v", lambda e: F.struct(F.xxhash64(e["term"]).alias("h"), e["w"].alias("w"))).alias("v"))
    pairs = spark.createDataFrame([(i, j, (i + j) % 3) for i in range(80) for j in range(0, i, 7)], "a long, b long, cell long")
    compared = lambda n: rows(dedup._compared(pairs, vectors, n).select("a", "b", F.round("product", 9)))
    assert compared(5) == compared(50) == compared(5000) and len(compared(5)) == pairs.count()


def test_vectors_are_not_written_for_every_pack(spark, monkeypatch):
    from gleaner.operators import vector_search as V

    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 8))
    vecs[7:60] = vecs[6]  # ties at the limit
    corpus = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(vecs)], "doc_id long, vector array<double>")
    written = []

    def cut(df):
        written.append(cut_lineage(df))
        return written[-1]

    monkeypatch.setattr(V, "cut_lineage", cut)
    monkeypatch.setattr(V, "SCORES", 900)  # several parts of a block
    got = V.nearest(corpus, corpus.withColumnRenamed("doc_id", "query_id"), 5, exclude_self=True, block_rows=40)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round((unit @ unit.T).reshape(200, 2, 200, 2).max(axis=(1, 3)), 6)  # two vectors of a query and of a document
    np.fill_diagonal(sims, -9)
    assert {(r.query_id, r["rank"]): (r.doc_id, r.similarity) for r in got.collect()} == {
        (i, n + 1): (int(j), float(sims[i, j])) for i in range(200) for n, j in enumerate(np.lexsort((np.arange(200), -sims[i]))[:5])}
    # a vector is written with the corpus and the queries, not with what is asked of ten packs
    assert max(d.count() for d in written if "unit" in d.columns) <= 400
    assert V.nearest(corpus, corpus.withColumnRenamed("doc_id", "query_id"), 5, exclude_self=True).count() == 1000
