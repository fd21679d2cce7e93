"""Language, summaries, text vectors, model outputs and the choice of rows to enrich."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import sentence_lines, squash, tokens
from ..session import cut_lineage
from .ranking import top_per_group

UNKNOWN = "unknown"


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, token, w)``: log frequency of every token of every language, learned from all texts."""
    counts = docs.select(lang, F.explode_outer(tokens(F.col(text))).alias("token")).where("token is not null").groupBy(lang, "token").agg(F.count("*").alias("n"))
    totals = counts.groupBy(lang).agg(F.sum("n").alias("total"))
    profile = counts.join(totals, lang).select(F.col(lang).alias("lang"), "token", F.ln(F.col("n") / F.col("total")).alias("w"))
    return cut_lineage(profile)  # learned once, looked up many times


COMMON_TOKENS, TOKEN_CHARS = 50_000, 64  # bound of what is broadcast: rows, and characters of each
LANGUAGES = 64  # languages whose weights stand beside each other in such a row


def detect_language(df: DataFrame, key: str, text: str, profiles: DataFrame, min_chars: int = 10, penalty: float = -12.0) -> DataFrame:
    """``(key, lang)``: highest sum of log weights over the tokens; ``penalty`` for a token outside a profile.

    Texts under ``min_chars`` characters or without any known token are ``unknown``. The weights of the commonest tokens
    in all languages are broadcast and added up where the text is read; only rarer tokens are shuffled to theirs.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # squashing the start alone tells for all but blank or short texts: what follows never shortens it
    long_enough = F.when(F.length(squash(F.substring(whole, 1, 64))) >= min_chars, True).otherwise(F.length(squash(whole)) >= min_chars)
    gains = profiles.select("lang", "token", "w", F.greatest(F.col("w") - penalty, F.lit(0.0)).alias("gain"))
    langs = [r.lang for r in profiles.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    langs = langs if len(langs) <= LANGUAGES else []
    beside = [F.max(F.when(F.col("lang").eqNullSafe(F.lit(l)), F.col("gain"))).alias(f"g{i}") for i, l in enumerate(langs)]
    common = gains.where(F.length("token") <= TOKEN_CHARS).groupBy("token").agg(F.max("w").alias("most"), *beside)
    common = common.orderBy(F.col("most").desc(), "token").limit(COMMON_TOKENS if langs else 0)
    words = df.where(long_enough).select(key, F.explode_outer(tokens(F.col(text))).alias("token"))
    rare = F.when(F.col("most").isNull(), F.col("token")).alias("rare")
    met = cut_lineage(words.join(F.broadcast(common), "token", "left").groupBy(key, rare).agg(
        F.count("*").alias("n"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(langs))]))
    found = met.where("rare is not null").join(gains, F.col("rare") == F.col("token")).select(key, "lang", (F.col("gain") * F.col("n")).alias("gain"))
    if langs:
        each = F.array(*[F.struct(F.lit(l).cast("string").alias("lang"), F.col(f"g{i}").alias("gain")) for i, l in enumerate(langs)])
        # a language without a gain, not even zero, knows none of the tokens
        found = found.unionByName(met.where("rare is null").select(key, F.inline(each)).where("gain is not null"))
    counts = found.groupBy(key, "lang").agg(F.sum("gain").alias("gain"))
    best = counts.groupBy(key).agg(F.min_by("lang", F.struct(-F.round("gain", 6), F.col("lang"))).alias("lang"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))


def needs_task(articles: DataFrame, done: DataFrame, task: str, article_topics: DataFrame | None = None) -> DataFrame:
    """``(article_id, task, content_hash)`` for eligible rows without a result at the current hash.

    Losers and unparseable articles are out; translate skips Chinese, topics skips articles a keyword tagged.
    """
    rows = articles.where("dedupe_of is null and status <> 'unparseable'")
    if task == "translate":
        rows = rows.where(F.coalesce("lang", F.lit("")) != "zh")
    if task == "topics":
        tagged = article_topics.where("method = 'keyword'").select("article_id")
        rows = rows.join(tagged, "article_id", "left_anti")
    wanted = rows.select("article_id", F.lit(task).alias("task"), "content_hash")
    return wanted.join(done.select("article_id", "task", "content_hash"), ["article_id", "task", "content_hash"], "left_anti")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n: how many lists of a batch hold the token."""
    for batch in batches:
        counts = pc.list_flatten(batch.column("tokens")).value_counts()
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["token", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """key, pos, rare, w, n: per list the sum and number of the known weights (rare is null), and a row per other token."""
    for batch in batches:
        lists = batch.column("tokens")
        owner = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
        coded = pc.list_flatten(lists).dictionary_encode()
        code = coded.indices.to_numpy()
        w = np.array([weights.get(t, np.nan) for t in coded.dictionary.to_pylist()], float)[code]
        known = ~np.isnan(w)
        n = np.bincount(owner[known], minlength=len(batch))
        some, rest = np.flatnonzero(n), np.flatnonzero(~known)
        total = np.bincount(owner[known], w[known], len(batch))
        at = pa.array(np.concatenate((some, owner[rest])))
        rare = pa.concat_arrays([pa.nulls(len(some), pa.string()), coded.dictionary.take(pa.array(code[rest]))])
        columns = [batch.column("key").take(at), batch.column("pos").take(at), rare,
                   pa.array(np.concatenate((total[some], np.full(len(rest), np.nan)))), pa.array(np.concatenate((n[some], np.ones(len(rest), np.int64))))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "rare", "w", "n"])


def summarize(df: DataFrame, key: str, text: str, max_points: int = 5, max_chars: int = 200) -> DataFrame:
    """Extractive summary ``(key, summary_text, key_points, confidence)``.

    Sentences are scored by the mean of ``ln(1 + documents / sentences with the token)`` over their distinct
    tokens. The best ``max_points`` become the key points in reading order; the summary is made of the leading ones,
    whole, as many as fit ``max_chars`` characters and one at least; the confidence is the share of the score the key
    points carry. Documents without a token have no row.

    Common tokens, nearly all the words of a text, are looked up in a broadcast table of bounded size where the text is
    read, so no stop word is ever a shuffle key; only rare tokens travel to their weight.
    """
    # outer forms: for the plain ones the optimizer adds size filters that cut the texts again
    words = df.select(F.col(key).alias("key"), F.posexplode_outer(sentence_lines(F.col(text))).alias("pos", "sentence")).where("pos is not null").select(
        "key", "pos", F.array_distinct(tokens(F.col("sentence"))).alias("tokens"))
    freq = cut_lineage(words.select("tokens").mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("df")))
    n = df.agg(F.count("*")).scalar()
    weights = freq.select("token", F.ln(1 + n / F.col("df")).alias("w"))
    common = freq.where(F.length("token") <= TOKEN_CHARS).orderBy(F.col("df").desc(), "token").limit(COMMON_TOKENS)
    common = common.select("token", F.ln(1 + n / F.col("df")).alias("w")).toArrow()  # of bounded size, like its broadcast
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(common.column("token").to_pylist(), common.column("w").to_pylist())))
    schema = f"key {df.schema[key].dataType.simpleString()}, pos int, rare string, w double, n long"
    met = cut_lineage(words.mapInArrow(lambda batches: _weighed(batches, shared.value), schema).withColumnRenamed("key", key))
    looked_up = met.where("rare is not null").join(weights.withColumnRenamed("w", "found"), F.col("rare") == F.col("token")).select(key, "pos", F.col("found").alias("w"), "n")
    scores = met.where("rare is null").select(key, "pos", "w", "n").unionAll(looked_up).groupBy(key, "pos").agg(
        F.round(F.sum("w") / F.sum("n"), 6).alias("score"))
    total = F.sum("score").over(Window.partitionBy(key))
    ranked = top_per_group(scores.withColumn("total", total), [key], [F.col("score").desc(), F.col("pos")], max_points)
    points = ranked.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("p"), F.sum("score").alias("kept"), F.first("total").alias("total"))
    # only the positions travel; the sentences are cut again from the text of their document
    lines = F.transform("p", lambda i: squash(F.element_at(F.col("s"), i + 1)))
    upto = lambda i: F.aggregate(F.slice("key_points", F.lit(1), i + 1), F.lit(-1), lambda length, s: length + 1 + F.length(s))
    leading = F.filter("key_points", lambda s, i: (i == 0) | (upto(i) <= max_chars))
    return (
        df.select(key, sentence_lines(F.col(text)).alias("s")).join(points, key)
        .withColumn("key_points", lines)
        .select(key, F.array_join(leading, " ").alias("summary_text"), "key_points",
                F.round(F.col("kept") / F.col("total"), 6).alias("confidence"))
    )


def text_vectors(df: DataFrame, key: str, text: str, dim: int = 1 << 12, model: Callable[[Column], Column] | None = None,
                 kind: str = "body") -> DataFrame:
    """``(key, kind, vector)`` of unit length: hashed tf-idf, or ``model`` - a pandas UDF over the text column."""
    if model is not None:
        return df.select(key, F.lit(kind).alias("kind"), model(F.col(text)).alias("vector"))
    tf = HashingTF(numFeatures=dim, inputCol="toks", outputCol="tf").transform(df.select(key, tokens(F.col(text)).alias("toks")))
    weighed = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="unit").transform(weighed)
    return unit.select(key, F.lit(kind).alias("kind"), vector_to_array("unit", "float32").alias("vector"))


# Literals as Python writes them.
LITERALS = {"True": "true", "False": "false", "None": "null"}
NAME, BRACKET = re.compile(r"[A-Za-z_]\w*"), re.compile(r"[{\[]")


def _value_from(text: str, start: int) -> tuple[str, int]:
    """The value whose bracket stands at ``start``, written strictly, and where it ends (-1: never closed).

    One walk that knows when it is inside a string. Strings in single quotes get double ones, raw control characters
    inside strings are escaped, commas before a closing bracket are left out, Python's literals become JSON's.
    """
    out, depth, quote, i = [], 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            rest = text[i + 1:i + 40].lstrip()
            if c == "\\" and i + 1 < len(text):
                out.append("'" if text[i + 1] == "'" else text[i:i + 2])
                i += 1
            elif c == quote and (quote == '"' or not rest or rest[0] in ",:}]"):
                out.append('"')
                quote = ""
            else:
                out.append('\\"' if c == '"' else c if c >= " " else f"\\u{ord(c):04x}")
        elif c in "\"'":
            out.append('"')
            quote = c
        elif c in "{[":
            out.append(c)
            depth += 1
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            out.append(c)
            depth -= 1
            if depth == 0:
                return "".join(out), i + 1
        elif (name := NAME.match(text, i)) is not None:
            out.append(LITERALS.get(name[0], name[0]))
            i = name.end() - 1
        else:
            out.append(c)
        i += 1
    return "".join(out), -1


def strict_json(raw: str) -> str:
    """The JSON object in a model's answer, written strictly; any thinking block before it is passed over.

    Brackets are tried in turn until one begins an object; what lies inside a value that parses to something else is not
    tried again. Without an object the first value that parses stands for the answer, else the first bracket's text.
    """
    text = raw.rpartition("</think>")[2].strip()
    start, first, other = 0, None, None
    while (match := BRACKET.search(text, start)) is not None:
        value, end = _value_from(text, match.start())
        first = value if first is None else first
        try:
            if isinstance(json.loads(value), dict):
                return value
            other = value if other is None else other
            start = end
        except ValueError:
            start = match.end()
    return other or first or text


def parse_outputs(df: DataFrame, raw: str, expected_keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Raw model output to JSON objects: ``(good, bad)``.

    ``good`` has parsed (variant) and missing_keys; what does not hold an object lands in ``bad`` with a reason.
    """

    @F.pandas_udf("string")
    def strict(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strict_json(t))

    def shape(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))

    plain = F.try_parse_json(raw)  # strict answers are not walked through again
    read = df.withColumn("_plain", plain).withColumn("_repaired", strict(F.when(~shape(F.col("_plain")), F.col(raw))))
    shaped = read.withColumn("parsed", F.when(shape(F.col("_plain")), F.col("_plain")).otherwise(F.try_parse_json("_repaired"))).drop("_plain", "_repaired")
    is_object = shape(F.col("parsed"))
    held = F.json_object_keys(F.to_json("parsed"))
    wanted = F.array(*[F.lit(k) for k in expected_keys]).cast("array<string>")
    good = shaped.where(is_object).withColumn("missing_keys", F.array_except(wanted, held))
    bad = shaped.where(~is_object).withColumn("reason", F.when(F.col("parsed").isNull(), "unparseable").otherwise("not an object"))
    return good, bad.drop("parsed")
