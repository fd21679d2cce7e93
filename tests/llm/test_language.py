"""Language identification: held-out accuracy, the weight of each kind of evidence, odd rows."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, label string, declared string, address string"


@pytest.fixture(scope="module")
def labelled(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("truth"))


def test_held_out_accuracy(labelled):
    held = (F.col("doc_id") % 2) == 1
    rows = labelled.select("doc_id", "text", F.when(~held, F.col("truth")).alias("label"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("address"))
    got = language.identified(rows).join(labelled, "doc_id").where(held).agg(F.avg((F.col("language") == F.col("truth")).cast("double")), F.avg(F.col("accepted").cast("double"))).first()
    assert got[0] >= 0.98 and got[1] >= 0.98


def test_other_evidence_decides_what_text_leaves_open(spark, labelled):
    base = labelled.select("doc_id", "text", F.col("truth").alias("label"), F.col("truth").alias("declared"), F.concat(F.lit("http://h."), "truth", F.lit(".example."), "truth", F.lit("/1")).alias("address"))
    odd = spark.createDataFrame([(9001, None, None, "fr", "http://h.fr.example.fr/2"), (9002, "", None, None, "x.es.example.es"), (9003, None, None, "de", None),
                                 (None, "12 34 %%% ### 56 78 " * 40, None, None, None), (9004, "the", "zz", None, None), (9004, "the", "zz", None, None)], COLUMNS)
    got = language.identified(base.unionByName(odd)).where("doc_id is null or doc_id > 9000").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[9001].language == "fr" and by[9002].language == "es" and by[9003].language == "de" and by[9004].language == "en"
    assert all(by[i].accepted for i in (9001, 9002, 9003, 9004))
    assert by[None].language == language.OTHER and not by[None].accepted


def test_no_labels_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "some text", None, None, None)], COLUMNS)
    assert [r.doc_id for r in language.identified(rows).collect()] == [1]
    assert language.identified(rows.limit(0)).count() == 0


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "http://a.b/fr/12.html?x=9", "<html lang='fr'>"), (2, "http://z.b/12", "<html lang='de'>"), (3, None, None), (4, "http://x.y/", ""),
                                   (5, "http://x.y/13", "<p>")], "page_id long, url string, html string")
    got = {r.doc_id: (r.declared, r.address) for r in language.page_evidence(pages).collect()}
    assert got == {12: ("fr", "http://a.b/fr/12.html?x=9"), 13: (None, "http://x.y/13")}
    docs = spark.createDataFrame([(12, None, "en", "s1", 1), (14, None, "en", "H.s.es", 1), (None, None, None, None, 1)], "doc_id long, text string, lang string, source string, page int")
    rows = {r.doc_id: (r.declared, r.host) for r in language.identified(language.labelled(docs), pages=language.page_evidence(pages)).collect()}
    assert rows == {12: ("fr", "a.b"), 14: (None, "h.s.es"), None: (None, None)}


def brute_posteriors(rows, model, languages):
    """Posterior of every row (text, declared, address) by the formulas of the docstring, row by row."""
    classes, strength = [*languages, language.OTHER], language.STRENGTH
    scores, first = [], []
    for text, _, _ in rows:
        codes = language.trigrams([text or ""])[0]
        total = model[codes].astype(np.float64).sum(axis=0)
        scores.append(total / (1 + len(codes) / language.TEMPER))
        first.append(int(np.argmax(scores[-1])))
    whole = [first.count(c) + 1 for c in range(len(classes))]
    overall = [n / sum(whole[:-1]) * (1 - language.OTHER_PRIOR) for n in whole[:-1]] + [language.OTHER_PRIOR]
    hosts = [re.match(r"^(?:[^/?#]*://)?([^/?#]*)", a or "").group(1).lower() or None for _, _, a in rows]
    domains = [h and ".".join(h.split(".")[-2:]) for h in hosts]
    suffixes = [h and h.split(".")[-1] for h in hosts]

    def seen(values, value):
        return [sum(v == value and f == c for v, f in zip(values, first)) for c in range(len(classes))]

    def likelihood(values, value):
        counts = seen(values, value)
        share = (sum(counts) + 1) / sum(whole)
        return [math.log((n + strength * share) / (t + strength)) for n, t in zip(counts, whole)][:-1] + [math.log(share)]

    out, declared = [], [d and d.lower() for _, d, _ in rows]
    for i, score in enumerate(scores):
        prior = overall
        if hosts[i]:
            above = seen(domains, domains[i])
            above = [(n + strength * p) / (sum(above) + strength) for n, p in zip(above, overall)]
            own = seen(hosts, hosts[i])
            prior = [(n + strength * p) / (sum(own) + strength) for n, p in zip(own, above)]
        joint = score + np.log(prior)
        for values in (declared, suffixes):
            if values[i]:
                joint = joint + likelihood(values, values[i])
        top = int(np.argmax(joint))
        out.append((classes[top], round(float(1 / np.exp(joint - joint[top]).sum()), 6)))
    return out


def test_posteriors_equal_a_plain_version(spark, labelled):
    rng, texts = random.Random(5), [(r.text, r.truth) for r in labelled.orderBy("doc_id").limit(80).collect()]
    rows = [(i, t[:rng.choice([5, 40, 4000])], truth, rng.choice([None, truth, "EN", "xx"]), rng.choice([None, "", f"http://H{i % 3}.{truth}.example.{truth}/x", f"a.b.{truth}"])) for i, (t, truth) in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "de", "de", "http://h1.de.example.de"), (902, texts[0][0], "zz", None, None), (902, texts[0][0], "zz", None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = brute_posteriors([(t, d, a) for _, t, _, d, a in rows], language.fitted(docs), language.LANGUAGES)
    got = sorted((r.doc_id, r.language, r.probability) for r in language.identified(docs).collect())
    want = sorted((r[0], *w) for r, w in zip(rows, want))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = spark.createDataFrame([(i, f"text number {i} of many", "en", None, None) for i in range(4000)] + [(9, "a copied text", "de", None, None)] * 500, COLUMNS)
    some, once = language.fitted(rows, ("en", "de"), 200), language.fitted(rows.dropDuplicates(["text"]), ("en", "de"), 1 << 40)
    assert abs(some[:, 2] - once[:, 2]).max() == 0
    everything = language.fitted(rows, ("en", "de"), 1 << 40)
    assert np.allclose(everything, once)
