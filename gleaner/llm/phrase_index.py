"""Benchmark decontamination on a positional inverted index of the training documents.

The index holds a posting (term, row, pos) for every word of every document, in segments that are sorted by term, so a
look-up skips what its terms cannot be in. A test item's windows are found by intersecting the posting lists of their
two rarest terms with offsets taken off; what is left is compared word by word with the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored, text_or_empty, words_of

WINDOW = 13
NO_ID = -(1 << 63)  # stands for a null doc_id in joins


def write_index(docs: DataFrame, path: str) -> None:
    """Writes the postings of ``docs`` (doc_id, text); nothing is shuffled, each task sorts what it has read.

    A document's own row has the empty term, its doc_id, the hash of its text and its number of words.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"),
                        words_of(text_or_empty()).alias("words"))
    words = words.withColumn("n", F.size("words").cast("long"))
    at = F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "term")
    own = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    (words.select("row", "id", "key", "n", at).select("term", "row", (F.col("pos") - 1).alias("pos"), own("id"), own("key"), own("n"))
     .sortWithinPartitions("term", "row", "pos").write.option("compression", "zstd").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, row long, pos int, id long, key long, n long").parquet(path)


def postings(index: DataFrame) -> DataFrame:
    return index.where("term <> ''").select("term", "row", "pos")


def indexed_documents(index: DataFrame) -> DataFrame:
    return index.where("term = ''").select("row", F.col("id").alias("doc_id"), "key", F.col("n").alias("n_words"))


def items_with_words(items: DataFrame) -> DataFrame:
    """item (text of item_id), words and number m, of items with an id and words; rows of equal id and words count once."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words_of(text_or_empty()).alias("words"))
    rows = rows.where("item is not null and size(words) > 0").distinct()
    return rows.select(F.monotonically_increasing_id().alias("test"), "item", "words", F.size("words").alias("m"))


def rarest_terms(index: DataFrame, tests: DataFrame) -> DataFrame:
    """test, p, term, n: the words of the tests with their numbers of postings; terms without any stay out."""
    terms = tests.select("test", F.posexplode("words").alias("p", "term"))
    counts = postings(index).groupBy("term").agg(F.count("*").alias("n")).join(terms.select("term").distinct(), "term", "left_semi")
    return terms.join(counts, "term")


def window_pairs(tests: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """test, p, term, p2, term2: for every window of a test all of whose words have postings, its two rarest places.

    Windows of one word have no second place.
    """
    size = F.least("m", F.lit(window))
    starts = tests.select("test", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("m") - size)).alias("s"))
    near = starts.join(terms, "test").where("p >= s and p < s + size")
    by = near.groupBy("test", "s", "size").agg(F.sort_array(F.collect_list(F.struct("n", "p", "term"))).alias("all")).where("size(all) = size")
    return by.select("test", F.col("all")[0]["p"].alias("p"), F.col("all")[0]["term"].alias("term"), F.get("all", F.lit(1))["p"].alias("p2"),
                     F.get("all", F.lit(1))["term"].alias("term2")).distinct()


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """test, row, diag: where the first word of a test would stand in a document that has both words of a pair in place."""
    first = postings(index).join(pairs, "term").select("test", "row", (F.col("pos") - F.col("p")).alias("diag"), "p2", "term2")
    alone = first.where("p2 is null").select("test", "row", "diag")
    second = postings(index).join(pairs.select(F.col("term2").alias("term")).dropna().distinct(), "term", "left_semi")
    both = first.where("p2 is not null").select("test", "row", "diag", F.col("term2").alias("term"), (F.col("diag") + F.col("p2")).alias("pos"))
    met = both.distinct().join(second, ["row", "term", "pos"]).select("test", "row", "diag")
    return alone.unionAll(met).distinct()


def phrase_matches(index: DataFrame, docs: DataFrame, tests: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, start, end: maximal stretches of at least ``window`` words (all, of shorter items) that a document and
    an item have in common, in words of the document."""
    # written first, so that its size is known when it meets the postings: a small one spares them a shuffle
    pairs = stored(window_pairs(tests, terms, window), "pairs")
    found = alignments(index, pairs).join(tests, "test")
    # the alignments of one document: no more than its words times the tests
    asked = found.groupBy("row").agg(F.collect_list(F.struct("test", "item", "words", "m", "diag")).alias("asked"))
    asked = asked.join(indexed_documents(index), "row").select("row", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key", "asked")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    each = asked.join(text, ["id", "key"]).select("row", words_of(F.col("text")).alias("have"), "asked").select("row", "have", F.inline("asked"))
    low = F.greatest("diag", F.lit(0))
    cut = each.select("row", "test", "item", "words", "m", "diag", F.slice("have", low + 1, F.greatest(F.col("m") + F.col("diag") - low, F.lit(0))).alias("have"))
    back = F.least(F.col("diag"), F.lit(0))
    same = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.coalesce(F.get("have", i + back) == F.get("words", i), F.lit(False)))
    places = cut.select("row", "test", "item", "m", "diag", F.explode(same).alias("i")).distinct()
    rank = F.row_number().over(Window.partitionBy("row", "test", "diag").orderBy("i"))
    runs = places.withColumn("run", F.col("i") - rank).groupBy("row", "test", "item", "m", "diag", "run").agg(F.min("i").alias("i"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= F.least("m", F.lit(window))).select("row", "item", (F.col("diag") + F.col("i")).alias("start"), (F.col("diag") + F.col("i") + F.col("n")).alias("end"))


def proximity_matches(index: DataFrame, tests: DataFrame, terms: DataFrame, within: int = WINDOW) -> DataFrame:
    """row, item: documents in which an item's two rarest terms, of those with postings, stand within so many words.

    The places of both terms are sorted together and only neighbours are compared, so no pairs are made.
    """
    by_rarity = F.row_number().over(Window.partitionBy("test").orderBy("n", "term"))
    rare = terms.select("test", "term", "n").distinct().withColumn("r", by_rarity).where("r <= 2").join(tests.select("test", "item"), "test")
    places = postings(index).join(stored(rare.select("item", "test", "term", "r"), "rare"), "term")
    order = Window.partitionBy("test", "row").orderBy("pos")
    near = places.withColumns({"back": F.lag("pos").over(order), "other": F.lag("r").over(order)})
    return near.where(F.col("other") != F.col("r")).where(F.col("pos") - F.col("back") <= within).select("row", "item").distinct()


def decontamination(docs: DataFrame, items: DataFrame, path: str, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, key (hash of the text), n_words, n_hit (words inside any window of an
    item), n_items, items_sha256, contaminated (hits, and at least one word in ``share``) and n_near (items whose two
    rarest terms stand close together).

    Null texts have no words and no hits; items without id or words are left out; without items nothing is hit. The
    index is written to ``path``.
    """
    spark = docs.sparkSession
    write_index(docs, path)
    index, tests = read_index(spark, path), stored(items_with_words(items), "tests")
    terms = stored(rarest_terms(index, tests), "terms")
    matches = stored(phrase_matches(index, docs, tests, terms, window).distinct(), "matches")
    hit = matches.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = matches.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = proximity_matches(index, tests, terms, window).groupBy("row").agg(F.count("*").alias("n_near"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = indexed_documents(index).join(hit, "row", "left").join(listed, "row", "left").join(near, "row", "left")
    ids: Column = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "n_words", zero("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      (F.coalesce(F.col("n_hit") * share >= F.col("n_words"), F.lit(False))).alias("contaminated"), zero("n_near"))
