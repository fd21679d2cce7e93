"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import pytest

from gleaner.llm import repeated_spans


def brute(texts):
    data, seen, out = [(t or "").encode() for t in texts], {}, []
    for b in data:
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    for doc, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, hot_from", [(1, 256), (2, 1), (3, 4)])
def test_against_brute_force(spark, seed, hot_from):
    rng = random.Random(seed)

    def letters(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    shared = [letters(n) for n in (199, 200, 201, 260, 400, 1000, 150)]
    texts = [None, "", "a" * 199, "b" * 200, "c" * 201, "de" * 300, "xyz" * 80 + "q" + "xyz" * 80, *shared, letters(60_000)]
    texts += [letters(rng.randint(0, 300)) + rng.choice(shared) + letters(rng.randint(0, 200)) + rng.choice(shared)[rng.randint(0, 60):] + letters(rng.randint(0, 100)) for _ in range(120)]
    texts += texts[20:24]
    frame = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, row string, packed binary").repartition(3)
    got = repeated_spans.removed_spans(frame, hot_from=hot_from).collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_nulls_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "r" * 10 + "s" * 150 + "t" * 90), (None, "r" * 10 + "s" * 150 + "t" * 90), (3, None)], "doc_id long, text string")
    got = repeated_spans.removed_spans(frame, keep_bytes=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.spans, bytes(r.kept)) for r in got) == [(0, 0, [], b""), (250, 250, [[0, 250]], b""), (250, 250, [[0, 250]], b"")]
    assert repeated_spans.removed_spans(frame.limit(0)).count() == 0
