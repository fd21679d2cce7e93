"""Spelling variants: pairs of sorted lists, and whole vocabularies with their forms and roots, against brute force."""

import random
import re
import zlib
from collections import Counter

from gleaner.llm import spelling

COLUMNS = "doc_id long, text string, word string, n int, low int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_sorted_lists():
    rng = random.Random(2)
    for _ in range(1500):
        words = sorted({"".join(rng.choices("abc"[:rng.randint(1, 3)], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 25))})
        got = list(spelling.one_edit_pairs(words))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if edits(words[i], words[j]) == 1}


def brute_vocabulary(rows, min_length, min_count, every):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}


def brute_groups(words, ratio=2):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    best = {w: min(((-words[v], v) for v in near[w]), default=None) for w in words}
    form = {w: b[1] if b and -b[0] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], COLUMNS)


def test_vocabulary_and_groups(spark):
    rng = random.Random(3)
    stems = ["colour", "Color", "groß", "Éclair", "aaaaa", "aaaaaa", "naïve", "×××××", "straße", "harbour"]
    rows = [(None, None), (None, ""), (1, "12 ... "), (None, "Colour colour COLOUR"), (2, "z" * 3000 + " " + "z" * 2999 + " " + "z" * 3000)]
    for i in range(400):
        word = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            word[rng.randrange(len(word))] = rng.choice("abcéz")
        rows.append((rng.choice([None, i, 7]), " ".join(["".join(word)] * rng.randint(1, 4)) + rng.choice([".", "\n", "1"])))
    rows += rows[:50]
    for every in (0, 3):
        table = spelling.vocabulary(docs(spark, rows), 5, 2, every)
        words = brute_vocabulary(rows, 5, 2, every)
        assert {r.word: r.n for r in table.collect()} == words
        for split_over in (64, 2):
            got = spelling.variant_groups(table, split_over=split_over).select("word", "form", "root", "n", "n_near", "form_n")
            assert sorted(map(tuple, got.collect())) == brute_groups(words)


def test_hot_group_and_long_chain(spark):
    """One half shared by all words, ties of n, and a chain of forms."""
    rng = random.Random(4)
    words = {"same" + "".join(rng.choices("abcd", k=4)): rng.choice([3, 3, 6, 50]) for _ in range(150)}
    words |= {"b" * k: 3 * 2 ** (k - 5) for k in range(5, 14)}
    frame = spark.createDataFrame([(w, n, 0) for w, n in words.items()], "word string, n int, root int")
    got = spelling.variant_groups(frame, split_over=8).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_groups(words)
    assert spelling.variant_groups(frame.limit(0)).count() == 0
    assert spelling.vocabulary(docs(spark, [])).count() == 0
