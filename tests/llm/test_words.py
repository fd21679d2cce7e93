"""Licence labels and phrase matches against brute force."""

import hashlib
import random

from gleaner.llm import licences, phrase_index
from gleaner.llm.common import stored
from gleaner.session import scratch_folder

from .test_pipeline import brute_hits, words


def brute_phrases(text):
    have, places, labels = words(text), [], set()
    for phrase, label in licences.PHRASES:
        want = phrase.split()
        for i in range(len(have) - len(want) + 1):
            if have[i:i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(have), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_and_notices(spark):
    rng = random.Random(3)
    vocabulary = ["cc", "by", "CC", "general", "public", "License", "all", "rights", "reserved", "of", "the", "é", "cc-by", "a_b"]
    texts = [None, "", "cc", "CC BY", "cc by cc by", "all rights, reserved all rights reserved", "x " * 30_000 + "cc by", *(n for n, _ in licences.NOTICES)]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(300)]
    # a notice with words put in and left out, twice, and one with half of it gone
    mit = words(licences.NOTICES[1][0])
    bent = " ".join(mit[:9] + ["very"] + mit[9:20] + mit[21:])
    texts += [f"w {bent} " + "w " * 50 + bent, " ".join(mit[:14])]
    frame = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    got = {r.doc_id: r for r in licences.with_labels(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
        assert (r.score == 1) >= (r.n_base > 0)
    for i, (_, label) in enumerate(licences.NOTICES):
        assert label in got[7 + i].labels.split(",") and got[7 + i].score == 1
    assert got[len(texts) - 2].labels == "mit" and 0.9 < got[len(texts) - 2].score <= 1
    assert got[len(texts) - 1].labels == "" and got[len(texts) - 1].score < 0.7
    rows = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by"), (1, None)], "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.n_base) for r in licences.with_labels(rows).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert licences.with_labels(rows.limit(0)).count() == 0


def brute_notices(text):
    """Labels of notices and the largest share, from every stretch of twice the notice's words."""
    have, labels, score = words(text), set(), 0
    for body, label in licences.NOTICES:
        want = words(body)
        votes = [(i, p) for i in range(len(have) - 1) for p in range(len(want) - 1) if have[i:i + 2] == want[p:p + 2]]
        chains, before = [], None
        for diag in sorted({i - p for i, p in votes}):
            if before is None or diag - before > licences.GAP:
                chains.append(set())
            chains[-1].add(diag)
            before = diag
        for chain in chains:
            mine = [v for v in votes if v[0] - v[1] in chain]
            for start, _ in mine:
                share = len({w for i, p in mine if start <= i <= start + 2 * len(want) - 2 for w in (p, p + 1)}) / len(want)
                score = max(score, share)
                if share >= licences.COVERED:
                    labels.add(label)
    return labels, score


def test_notices_chained_to_their_neighbours(spark):
    rng = random.Random(6)
    grams = [" ".join(w[a:a + rng.randint(2, 5)]) for w in (words(n) for n, _ in licences.NOTICES) for a in range(len(w) - 1)]
    texts = ["CC BY, CC BY, CC BY, CC BY, CC BY: licensed under CC BY-NC 4.0", "CC BY " * 300 + "licensed under CC BY-NC 4.0 " + "under CC " * 300]
    texts += [" ".join(rng.choices(grams + [n for n, _ in licences.NOTICES] * 3 + ["x", "y z"] * 20, k=rng.randint(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licences.with_labels(frame).collect()}
    assert all("cc-by-nc-4.0" in got[i].labels.split(",") and got[i].score == 1 for i in (0, 1))
    for i, t in enumerate(texts):
        labels, score = brute_notices(t)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == labels | base, t
        assert got[i].score >= score and (base or got[i].score in (score, 0.5, 1 / 3, 2 / 3) or abs(got[i].score - score) < 1e-9), t


def test_contamination(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", "the"]

    def some(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(0, some(40)), (1, some(13)), (2, some(12)), (3, "the"), (4, ""), (5, None), (None, some(20)), (6, "absent words only here"), (10, "a a a a a a a a a a a a a a a"), (7, some(40)), (7, some(30)), (8, "w1 w1")]
    texts = [None, "", "the", "x the", "a " * 40, "a " * 14, "y " * 20_000 + "the", some(400)]
    for _ in range(120):
        _, item = rng.choice([i for i in items if i[1]])
        w = item.split()
        a = rng.randrange(len(w))
        texts.append(" ".join([some(rng.randint(0, 60)), " ".join(w[a:a + rng.randint(1, 30)]), some(rng.randint(0, 30)), rng.choice([item, "", " ".join(w[:13])])]))
    frame = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, item long").repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in phrase_index.decontamination(frame, tests, scratch_folder(spark, "t")).collect()}
    real = [(i, t) for i, t in items if i is not None]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit = brute_hits(t, [t2 for _, t2 in real])
        ids = sorted({str(k) for k, t2 in real if brute_hits(t, [t2])[1]})
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0 and 20 * hit >= n), t
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    rows = spark.createDataFrame([(None, "the"), (1, "the"), (1, "the")], "doc_id long, text string")
    assert [r.n_hit for r in phrase_index.decontamination(rows, tests, scratch_folder(spark, "t")).collect()] == [1, 1, 1]
    assert [r.n_hit for r in phrase_index.decontamination(rows, tests.limit(0), scratch_folder(spark, "t")).collect()] == [0, 0, 0]
    assert phrase_index.decontamination(rows.limit(0), tests, scratch_folder(spark, "t")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "aa x bb"), (2, "bb " + "x " * 11 + "aa"), (3, "aa " + "x " * 13 + "bb"), (4, "aa aa"), (5, "x x")], "doc_id long, text string")
    path = scratch_folder(spark, "t")
    phrase_index.write_index(docs, path)
    index = phrase_index.read_index(spark, path)
    tests = stored(phrase_index.items_with_words(spark.createDataFrame([("i", "x bb x aa"), ("j", "x")], "item_id string, text string")), "t")
    near = phrase_index.proximity_matches(index, tests, phrase_index.rarest_terms(index, tests)).join(phrase_index.indexed_documents(index), "row")
    assert sorted((r.doc_id, r.item) for r in near.collect()) == [(1, "i"), (2, "i")]


def test_long_chains_of_diagonals_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from gleaner.llm.catalog import ORACLES, QUERIES

    texts = ["CC BY, CC BY, CC BY, CC BY, CC BY: licensed under CC BY-NC 4.0", "licensed under " * 30 + "the GNU General Public License, version 3", "CC BY " * 40, None, "",
             "the terms of the " * 20 + "Mozilla Public License. This Source Code Form is subject to the terms of the Mozilla Public License"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(ORACLES["op5_licences"])
    got = QUERIES["op5_licences"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and "cc-by-nc-4.0" in sorted(map(tuple, got))[0][6]
