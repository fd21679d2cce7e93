"""SimHash index and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from gleaner.llm import gray_index
from gleaner.llm.components import component_roots


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    nodes, out = list(dict.fromkeys(prints)), {}
    for p in nodes:
        if p in out:
            continue
        todo, seen = [p], {p}
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in seen and (x ^ y).bit_count() <= distance:
                    seen.add(y)
                    todo.append(y)
        out.update(dict.fromkeys(seen, frozenset(seen)))
    return out


def test_fingerprints():
    for text in [None, "", " \n", "a", "A b", "a b c", "É a\x0bB c d", "a b c d e f g a b c", "x " * 500, "\x1c a b c d"]:
        assert gray_index.fingerprint(text or "") == brute_print(text), text


@pytest.mark.parametrize("seed", range(5))
def test_links_of_one_group(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    prints = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(120)})
    index = gray_index.GrayIndex(np.array(prints, np.uint64), fanout=rng.choice([2, 5, 16]))
    q, m = index.near(np.arange(len(prints)), 2)
    got = {(int(index.prints[a]), int(index.prints[b])) for a, b in zip(q, m)}
    assert got == {(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 2}
    forest = index.links(2)
    assert len(forest) < len(prints)
    roots = {}
    for a, b in index.prints[forest].tolist():
        assert (a ^ b).bit_count() <= 2
        merged = roots.get(a, {a}) | roots.get(b, {b})
        roots.update(dict.fromkeys(merged, merged))
    want = brute_components(prints, 2)
    assert all(roots.get(p, {p}) == want[p] for p in prints)


@pytest.mark.parametrize("split_over", [2, 1_000])
def test_near_duplicates(spark, split_over):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base = " ".join(rng.choices(words, k=60)).split()
    texts = [None, "", "a", "a", "A", "b c", "x" * 5000] + [" ".join(rng.choices(words, k=30)) for _ in range(20)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
    frame = spark.createDataFrame([(500 - i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, root string")
    got = gray_index.near_duplicates(frame, split_over=split_over).collect()
    prints = {500 - i: brute_print(t) for i, t in enumerate(texts)}
    classes = brute_components(prints.values(), 2)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()} and len(got) == len(texts)
    for r in got:
        assert r.component_id == min(d for d, p in prints.items() if p in classes[prints[r.doc_id]])
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, None)], "doc_id long, text string")
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in gray_index.near_duplicates(rows).collect()) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert gray_index.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {}
    for a, b in edges:
        merged = want.get(a, {a}) | want.get(b, {b})
        want.update(dict.fromkeys(merged, merged))
    assert got == {n: min(c) for n, c in want.items() if min(c) != n}
