"""Pipeline stages on the small tables and on odd rows, each against a plain version on its own input."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm.common import stored

from .test_fuzzy_lines import brute_dropped
from .test_gray_index import brute_components, brute_print

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(text, items):
    """Number of words, and of those inside a window of an item."""
    have, hit = words(text), set()
    for item in items:
        want = words(item)
        n = min(13, len(want))
        grams = {tuple(want[i:i + n]) for i in range(len(want) - n + 1)} if n else set()
        for i in range(len(have) - n + 1 if n else 0):
            if tuple(have[i:i + n]) in grams:
                hit.update(range(i, i + n))
    return len(have), len(hit)


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (100001, "", "en", "s", 0), (100002, None, "en", None, None), (100002, None, "en", None, None)], COLUMNS)
    # columns with the names that the stages use themselves
    clashing = {c: F.lit(c) for c in ("_id", "_key", "_did", "did", "dkey", "key", "row", "at_id", "language", "accepted", "dropped", "label", "best")}
    docs = stored(docs.unionByName(odd).withColumns(clashing), "docs")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        was, now = before.collect(), {r.doc_id: r for r in after.collect()}
        if name == "language_id":
            assert set(now) >= {r.doc_id for r in was if r.text}
        elif name == "line_dedup":
            gone = brute_dropped([(r.doc_id, r.text) for r in was if r.doc_id is not None])
            assert set(now) == {r.doc_id for r in was}
            for r in was:
                if r.text is not None:
                    assert now[r.doc_id].text == "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(r.doc_id, []))
        elif name == "simhash_dedup":
            prints = {r.doc_id: brute_print(r.text) for r in was if r.doc_id is not None}
            classes = brute_components(prints.values(), 2)
            assert set(now) - {None} == {min(d for d, p in prints.items() if p in c) for c in set(classes.values())}
            assert after.count() == len(now)
        else:
            bad = {r.doc_id for r in was for n, hit in [brute_hits(r.text, items)] if hit and 20 * hit >= n}
            assert bad and set(now) == {r.doc_id for r in was} - bad
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
