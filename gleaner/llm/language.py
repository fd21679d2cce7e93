"""Language identification by Bayesian fusion of evidence.

For every document the posterior of each language is proportional to: the likelihood of its text under byte-trigram
models (tempered, as neighbouring trigrams are not independent), the likelihoods of the language it declares and of its
address suffix, and a prior for its host. The last three are counted over all documents by grouped aggregation of what
their texts alone say; a host's prior is smoothed towards its domain's, the domain's towards that of all documents. One
class more stands for text in none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, stored, text_or_empty

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "und"
SAMPLE = 1_500  # labelled documents per language that the text models are fitted on, about
BUCKETS = 1 << 14
TEMPER = 60.0  # a text of n trigrams counts as TEMPER * n / (TEMPER + n) independent ones
STRENGTH = 20.0  # documents that the level above a host or domain is worth
OTHER_PRIOR = 0.01
ACCEPT = 0.5


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the lower-cased texts with a space around each, and where each text's begin."""
    data = [f" {t.lower()} ".encode() for t in texts]
    buf = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    length = np.array([len(d) for d in data])
    ends = np.cumsum(length)
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        at = ends[:-1] - back
        inside[at] = False
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    count = np.maximum(length - 2, 0)
    return hashed[inside], np.cumsum(count) - count


def fitted(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """(buckets, classes) log likelihoods from a bounded sample of rows (text, label); the last class is flat.

    The sample holds the texts of each label whose hash lies below a bound set by the label's row count, about ``sample``
    of them, each once; it does not depend on partitioning, and only its own texts are shuffled. The counts that reach the
    driver are one number per language and bucket.
    """
    rows = docs.where(F.col("label").isin(*languages)).select("label", text_or_empty().alias("text"))
    count_of = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound = {label: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * sample // n) for label, n in count_of.items()}
    below = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair]) if bound else F.create_map().cast("map<string,bigint>")
    rows = (rows.where("text <> ''").withColumn("h", F.xxhash64("text")).where(F.col("h") <= below[F.col("label")])
            .groupBy("label", "h").agg(F.first("text").alias("text")).select("label", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = np.array(batch.column("label").to_pylist()), batch.column("text").to_pylist()
            for label in set(labels.tolist()):
                seen = np.bincount(trigrams([t for t, x in zip(texts, labels) if x == label])[0], minlength=BUCKETS)
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(seen[at])], names=["label", "bucket", "n"])

    counted = rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages) + 1), 0.5)
    for r in counted.collect():
        table[r.bucket, languages.index(r.label)] += r.n
    table[:, -1] = 1
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` with its text replaced by ``score``: the tempered log likelihood of each class."""
    kept = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = np.zeros((len(texts), model.shape[1]))
            start = held = 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > 1 << 19 or i + 1 == len(texts):
                    code, cuts = trigrams(texts[start:i + 1])
                    n = np.diff(np.append(cuts, len(code)))
                    full = n > 0
                    if full.any():
                        total = np.add.reduceat(model[code].astype(np.float64), cuts[full], axis=0)
                        out[start:i + 1][full] = total / (1 + n[full, None] / TEMPER)
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(list(out), pa.list_(pa.float64()))], names=[*kept, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.mapInArrow(score, f"{fields}, score array<double>")


def address_parts(address: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix (the last one) of an address; null without a host."""
    host = F.nullif(F.translate(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[^/?#]*://)?([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER), F.lit(""))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, accept: float = ACCEPT, sample: int = SAMPLE,
               pages: DataFrame | None = None) -> DataFrame:
    """Languages of ``docs`` (doc_id, text, label, declared, address; one row each, other columns stay out).

    Returns doc_id, dkey (hash of the text), language, probability, text_language, declared, host and accepted: false if
    no language reaches ``accept`` against the others and the class of none. Null or empty texts have no trigrams of
    their own and are judged by the rest; missing evidence counts for nothing; unknown labels are not fitted on. Without
    labelled rows the text says nothing. Rows are independent of each other but for the shared counts.

    With ``pages``, rows of ``page_evidence``, declared and address are not read from ``docs``: they are the page's of the
    same doc_id, and a document without one declares nothing and has its ``source`` for an address. Texts are scored where
    they are read; only scores meet the pages.
    """
    classes, model = (*languages, OTHER), fitted(docs, languages, sample)
    evidence = ["declared", "address"] if pages is None else ["source"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("dkey"), text_or_empty().alias("text"), *evidence)
    scores = text_scores(base, model)
    if pages is not None:
        page = pages.select(F.col("doc_id").alias("page_doc"), "declared", "address")
        met = F.col("doc_id") == F.col("page_doc")
        scores = scores.join(page, met, "left").withColumn("address", F.coalesce("address", "source")).drop("page_doc", "source")
    scores = scores.select("doc_id", "dkey", "score", F.lower("declared").alias("declared"), *[c.alias(n) for n, c in address_parts(F.col("address")).items()])
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("score", F.array_max("score")).cast("int"))
    scored = stored(scores.withColumn("text_language", best), "language")
    every = F.array(*map(F.lit, classes))

    def counts(key: str) -> DataFrame:
        """A row per value of ``key``: how many documents of each class by text."""
        each = [F.count_if(F.col("text_language") == c).cast("double").alias(f"n{i}") for i, c in enumerate(classes)]
        return scored.where(F.col(key).isNotNull()).groupBy(key).agg(*each).select(key, F.array(*[f"n{i}" for i in range(len(classes))]).alias(f"{key}_counts"))

    total = scored.agg(*[F.count_if(F.col("text_language") == c).alias(f"n{i}") for i, c in enumerate(classes)]).first()
    whole = np.array([float(n or 0) for n in total]) + 1
    overall = whole[:-1] / whole[:-1].sum() * (1 - OTHER_PRIOR)
    overall = np.append(overall, OTHER_PRIOR)
    constant = lambda a: F.array(*[F.lit(float(x)) for x in a])
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    zeros = constant(np.zeros(len(classes)))
    host, domain = counts("host").join(scored.where("host is not null").select("host", "domain").distinct(), "host"), counts("domain")

    def smoothed(seen: str, above: Column) -> Column:
        return F.zip_with(F.col(seen), above, lambda n, p: (n + STRENGTH * p) / (summed(F.col(seen)) + STRENGTH))

    domain_prior = domain.withColumn("domain_prior", smoothed("domain_counts", constant(overall))).select("domain", "domain_prior")
    host_prior = host.join(domain_prior, "domain").withColumn("prior", smoothed("host_counts", F.col("domain_prior"))).select("host", "prior")

    def likelihood(key: str) -> DataFrame:
        """log P(value | class) with a share of the value's frequency among all; the class of none takes the frequency."""
        seen = counts(key)
        n = float(whole.sum())
        share = (summed(F.col(f"{key}_counts")) + 1) / n
        each = F.zip_with(F.col(f"{key}_counts"), constant(whole), lambda c, t: F.log((c + STRENGTH * share) / (t + STRENGTH)))
        return seen.select(key, F.zip_with(each, every, lambda x, c: F.when(c == OTHER, F.log(share)).otherwise(x)).alias(f"{key}_score"))

    out = scored
    for key, known in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", host_prior)):
        # rows without a value are dealt out by their text; no value begins with that character
        own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("dkey").cast("string")))
        out = out.join(known.withColumnRenamed(key, "known"), own == F.col("known"), "left").drop("known")
    parts = [F.col("score"), F.coalesce("declared_score", zeros), F.coalesce("suffix_score", zeros),
             F.transform(F.coalesce("prior", constant(overall)), lambda p: F.log(p))]
    joint = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    out = out.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    probability = 1 / summed(F.transform("joint", lambda x: F.exp(x - F.col("top"))))
    language = F.element_at(every, F.array_position("joint", F.col("top")).cast("int"))
    return (out.withColumns({"language": language, "probability": probability})
            .select("doc_id", "dkey", "language", F.round("probability", 6).alias("probability"), "text_language", "declared", "host",
                    ((F.col("language") != OTHER) & (F.col("probability") >= accept)).alias("accepted")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, declared, address: what ``pages`` (url, html) say of the document whose number their path ends with.

    A page declares the language of its ``html`` tag, or none. Of several pages of a document the one with the smallest
    address counts, then the smallest declaration. Null urls, and paths without a number, belong to no document.
    """
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/(?:[^?#]*/)?(\d{1,18})(?:\.\w+)?/?(?:[?#]|$)", 1)
    declared = F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1), F.lit(""))
    page = pages.select(F.nullif(number, F.lit("")).cast("long").alias("doc_id"), F.struct("url", declared.alias("declared")).alias("page"))
    return page.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min("page").alias("page")).select("doc_id", "page.declared", F.col("page.url").alias("address"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, label and source of ``docs`` (doc_id, text, lang, source): ``lang`` is what the text models are fitted on."""
    return docs.select("doc_id", "text", F.col("lang").alias("label"), "source")
