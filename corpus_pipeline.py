"""A training corpus from ``documents``: each stage writes what it keeps as Parquet, and the next one reads that.

Stages return rows with the columns of ``documents`` (doc_id, text, lang, source, n_chars), the last one the pieces of
packed sequences. Decisions are brought back by (doc_id, hash of the text), so that null and repeated ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm import fuzzy_lines, gray_index, language, packing, phrase_index
from gleaner.llm.common import NO_ID, matched, stored, table
from gleaner.llm.queries import vocabulary
from gleaner.session import scratch_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages; the others keep their text and get the identified language as lang.

    Rows with a null or empty text are judged by their page and source; rows equal in doc_id and text share a decision.
    Other columns pass through, whatever their names.
    """
    found = language.identified(language.labelled(docs), pages=language.page_evidence(table(spark, sf_dir, "pages")))
    found = found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "dkey").agg(
        F.max("accepted").alias("accepted"), F.max_by("language", "probability").alias("language"))
    kept = matched(docs, found, "inner").where("accepted")
    return kept.select(F.col("row").withField("lang", F.col("language")).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of every group of similar lines; documents stay, with the lines that are left to them.

    Null and empty texts have no lines to drop; rows equal in doc_id and text keep the same lines.
    """
    return fuzzy_lines.without_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints the one with the smallest doc_id stays; null ids come last.

    Documents without words are linked with each other. Of rows equal in doc_id and text one stays, as they are copies.
    """
    docs = docs.dropDuplicates(["doc_id", "text"])
    classes = gray_index.near_duplicates(docs.select(F.col("doc_id"), "text"), with_key=True)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    leads = classes.groupBy("root").agg(F.min(first).alias("first")).select(F.coalesce("first.doc_id", F.lit(NO_ID)).alias("did"), F.col("first.key").alias("dkey"))
    return matched(docs, leads, "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least one in 20 stands in a window of a benchmark item; those without words stay."""
    judged = phrase_index.decontamination(docs, table(spark, sf_dir, "benchmark"), scratch_folder(spark, "postings"))
    gone = judged.where("contaminated").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.col("key").alias("dkey")).distinct()
    return matched(docs, gone, "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens; one row per piece, only columns of the packing.

    A null or empty text is its end token alone; repeated rows are documents of their own.
    """
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


ORACLE_SQL = None  # fingerprints and token ids are beyond SQL; tests hold the stages against brute force
