"""Ranked search: range maxima and whole rankings against plain scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import lexical
from gleaner.session import scratch_folder


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_ranking(rows, items, k):
    held = [(i, Counter(t), len(t)) for i, text in rows for t in [terms(text)] if t]
    n, length, out = len(held), sum(x[2] for x in held), []
    df = Counter(t for _, c, _ in held for t in c)
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for doc, counts, size in held:
            m = 75 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_range_maxima():
    rng = np.random.default_rng(3)
    for _ in range(60):
        docs = int(rng.integers(1, 40))
        places = [np.sort(rng.choice(docs, int(rng.integers(1, docs + 1)), replace=False)) for _ in range(int(rng.integers(1, 5)))]
        impacts = [rng.integers(1, 6, len(p)) for p in places]
        lists, times = lexical.Lists(docs, places, impacts), rng.integers(1, 3, len(places))
        low = rng.integers(lists.starts, lists.ends + 1, (9, len(places)))
        high = rng.integers(low, lists.ends + 1)
        bound, split = lists.rate(low, high, times)
        for a, b, value, doc in zip(low, high, bound, split):
            most = [lists.impact[x:y].max() * t if y > x else 0 for x, y, t in zip(a, b, times)]
            assert value == sum(most)
            if value:
                top = int(np.argmax(most))
                assert doc in lists.place[a[top]:b[top]][lists.impact[a[top]:b[top]] * times[top] == max(most)]
        score = np.zeros(docs, np.int64)
        for p, x, t in zip(places, impacts, times):
            score[p] += x * t
        for k in (1, 3, 100):
            found, got = lists.best(np.arange(len(places)), times, k)
            want = sorted((-s, d) for d, s in enumerate(score) if s)[:k]
            assert [(-s, d) for s, d in zip(got, found)] == want


def test_rankings_against_plain_scoring(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["é", "Straße", "UPPER", "x9"]
    rows = [(None, None), (1, ""), (2, "... --"), (3, "w1 " * 5000)] + [(rng.choice([None, i]), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(4, 200)]
    rows += [(500 + i, rows[20][1]) for i in range(60)] + rows[30:40]  # a hot group of copies, and repeated rows
    items = [(i, " ".join(rng.choices([*words, "unknown"], k=rng.randint(1, 12)))) for i in range(25)] + [(90, None), (91, "..."), (92, "nowhere"), (None, "w1 w2"), (93, rows[20][1]), (1, "w1 w1 W1")]
    items.append(items[0])
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, term string, segment int").repartition(3)
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, query string")
    for size in (300, 1 << 20):
        path = scratch_folder(spark, "lexical")
        lexical.write_index(docs, path, segment_terms=size)
        for k, block in ((20, 200_000), (3, 40)):
            got = lexical.search(spark, path, asked, k, block)
            assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(rows, items, k)
    assert spark.read.schema(lexical.INDEX).parquet(path).where(F.col("term") == "w1").agg(F.sum("n")).first()[0] == sum("w1" in terms(t) for _, t in rows)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for rows, asked in ((docs, items), (spark.createDataFrame([(1, "a b")], docs.schema), items.limit(0)), (spark.createDataFrame([(1, None)], docs.schema), items)):
        path = scratch_folder(spark, "lexical")
        lexical.write_index(rows, path)
        assert lexical.search(spark, path, asked).count() == 0
