"""Fuzzy line dedup against all pairs."""

import random

from gleaner.llm import fuzzy_lines


def brute_dropped(rows, similarity=0.8):
    """Dropped line numbers by row, from all pairs of lines."""
    spots = [(doc_id, n, line.strip()) for doc_id, t in rows for n, line in enumerate((t or "").split("\n")) if line.strip()]
    bodies = list(dict.fromkeys(b for *_, b in spots))
    root = {b: b for b in bodies}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [fuzzy_lines.shingles(b) for b in bodies]
    order = sorted(range(len(bodies)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1:]:
            x, y = sets[i], sets[j]
            if len(x) < similarity * len(y):
                break
            both = len(x & y)
            if both >= similarity * (len(x) + len(y) - both):
                root[find(bodies[i])] = find(bodies[j])
    seen, out = set(), {}
    for doc_id, n, body in sorted(spots, key=lambda s: s[:2]):
        if find(body) in seen:
            out.setdefault(doc_id, []).append(n)
        seen.add(find(body))
    return out


def documents(rng):
    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n))

    bases = [words(40) for _ in range(6)]

    def near(line):
        parts = line.split()
        parts[rng.randrange(len(parts))] = words(1)
        return " ".join(parts)

    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "short\nshort\n short \nshor"), (4, "é" * 3000), (5, "x " * 40_000 + "\nx")]
    for i in range(6, 60):
        rows.append((i, "\n".join(rng.choice([rng.choice(bases), near(rng.choice(bases)), words(20), "", "  " + rng.choice(bases)]) for _ in range(rng.randint(1, 6)))))
    return rows


def test_against_all_pairs(spark):
    rows = documents(random.Random(11))
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, line string, did int").repartition(5)
    got = {r.doc_id: r for r in fuzzy_lines.line_report(frame).collect()}
    want = brute_dropped(rows)
    assert {i: r.dropped for i, r in got.items() if r.dropped} == want
    assert all(got[i].n_lines == len((t or "").split("\n")) and got[i].n_dropped == len(want.get(i, [])) for i, t in rows)
    texts = {r.doc_id: r.text for r in fuzzy_lines.without_copies(frame).collect()}
    for i, t in rows:
        assert texts[i] == ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(i, [])) if t is not None else None)


def test_nulls_ties_and_empty_table(spark):
    rows = [(None, "one line of text here"), (7, "one line of text here"), (7, "one line of text here"), (7, "another line\none line of text here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_lines, r.dropped) for r in fuzzy_lines.line_report(frame).collect())
    assert got == [("7", 1, [0]), ("7", 1, [0]), ("7", 2, [1]), ("None", 1, [])]
    assert fuzzy_lines.line_report(frame.limit(0)).count() == 0
    assert fuzzy_lines.without_copies(frame.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=400))
    found = 0
    for _ in range(300):
        at = rng.randrange(0, 380)
        other = base[:at] + "".join(rng.choices("xyz", k=12)) + base[at + 12:]
        a, b = fuzzy_lines.band_keys([base, other])
        assert fuzzy_lines.jaccard(base, other) > 0.8
        found += bool((a == b).any())
    assert found >= 297


def test_pairs_of_large_buckets_are_verified_whatever_their_signatures(spark):
    rng = random.Random(1477)
    line = "q" + "".join(rng.choices("abcdefgh ", k=130)) + "q"
    at = rng.randrange(10, 100)
    other = line[:at] + "".join(rng.choices("xyz", k=8)) + line[at + 8:]
    minima, (a, b) = fuzzy_lines.signatures([line, other]), fuzzy_lines.band_keys([line, other])
    # similar, and in a bucket together, with two in three minima equal
    assert fuzzy_lines.jaccard(line, other) >= 0.8 and (a == b).any() and (minima[:, 0] == minima[:, 1]).mean() < 0.68
    short = line[:40]
    bodies = [line, other, *("".join(rng.choices("abcdefgh ", k=rng.randint(20, 300))) for _ in range(1500)), short, short + "x", short + "y"]
    lines = spark.createDataFrame(list(enumerate(bodies)), "line long, body string")
    members = lines.selectExpr("1L AS bucket", "line")
    roots = spark.createDataFrame([], "line long, root long")
    found = {tuple(sorted(r)) for r in fuzzy_lines.across_components(members, roots, lines, 0.8).collect()}
    # edges between lines that others join may be left out
    assert (0, 1) in found and len(found - {(0, 1)}) >= 2 and found - {(0, 1)} <= {(1502, 1503), (1502, 1504), (1503, 1504)}
