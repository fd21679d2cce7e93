"""SetSketch near-duplicates: registers and their likelihood, components against brute force, a hot family."""

import random

import numpy as np
import pyarrow as pa

from gleaner.llm import set_sketch as sk

COLUMNS = "doc_id long, text string, key string, node int, bucket int"


def sets_of(texts):
    return sk.hashed_sets(pa.array(texts))[0]


def test_sets_of_shingles():
    texts = [None, "", " \n", "one", "One two", "a b c", "A b\tc", "a b c a b c", "é É b c d", "a\x0bb\x0cc d", "a\xa0b c d"]
    sets, keys = sk.hashed_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(sk.shingle_set(t)) for t in texts]
    assert keys[5] == keys[6] and len(set(keys[[3, 4, 5, 7, 8, 9, 10]].tolist())) == 7 and not keys[:3].any()


def test_registers_merge_and_tell_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.7, 0.85, 0.95):
        kept = []
        for _ in range(40):
            both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            x, y, union = sk.registers([np.append(both, a), np.append(both, b), np.concatenate((both, a, b))])
            assert (sk.merged(x, y) == union).all()
            size = np.array([float(len(both) + len(a))])
            kept.append(bool(sk.plausible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), size, size)[0]))
        assert all(kept) if share >= 0.85 else not any(kept) if share == 0.5 else True


def brute_components(rows, percent=85):
    sets = [(i, sk.shingle_set(t or "")) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (doc, x) in enumerate(sets):
        ids = [d for j, (d, _) in enumerate(sets) if find(j) == find(i) and d is not None]
        smallest = min(ids, default=None) if x else doc
        out.append((doc, len(x), smallest, doc is not None and doc == smallest))
    return sorted(out, key=repr)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(None, None), (None, ""), (900, " "), (901, "One"), (902, "one"), (903, "one two"), (904, "w " * 4000), (905, "w " * 5000), (None, "only null ids here today"), (None, "Only null ids here today")]
    for family in range(12):
        base = [f"f{family}w{rng.randrange(40)}" for _ in range(rng.choice([8, 40, 150]))]
        rows += [(rng.choice([None, len(rows), len(rows)]), edited(rng, base, rng.choice([0, 0, 1, 2, 4, 8]))) for _ in range(14)]
    rows += rows[10:30]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], COLUMNS)
    assert sorted(map(tuple, sk.near_duplicates(docs).collect()), key=repr) == brute_components(rows)
    assert sk.near_duplicates(docs.limit(0)).count() == 0


def test_hot_family_of_unlinked_and_chained_texts(spark, monkeypatch):
    """Many texts about as similar as the limit: stars miss links, which pairs across components must find."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.choice([2, 3, 4, 5]))) for i in range(120)] + [(500 + i, " ".join(base)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], COLUMNS)
    monkeypatch.setattr(sk, "BLOCK", 16)
    monkeypatch.setattr(sk, "PARTNERS", 4)
    assert sorted(map(tuple, sk.near_duplicates(docs).collect()), key=repr) == brute_components(rows)
