"""URL filter lists: host-suffix and path-prefix expressions, met on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER

PREFIX_HEX = 8  # hex digits of a digest that the join sees: four bytes


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def with_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest host and path together
    win, then the longer host; of equal rules ``block`` wins. Null urls and urls without ``://`` have an empty host and
    path. Without a fitting rule, or with an empty rule table, the verdict is ``default``. Columns of ``pages`` named
    host, path, rule or verdict are replaced.

    Only the distinct pairs of host and path are expanded, so a hot url is judged once. Suffixes are taken at label
    boundaries and prefixes at the path lengths that occur among the rules, which are fewer than the longest path.
    """
    listed = (rules.select("host", "path", "verdict").dropna()
              .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks")))
    listed = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
                           F.when(F.col("blocks"), "block").otherwise("allow").alias("found"))
    lengths = listed.agg(F.sort_array(F.collect_set(F.char_length("rule_path"))).alias("path_lengths"),
                         F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("label_counts"))
    row = lengths.first()
    keyed = listed.withColumn("full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.left("full", F.lit(PREFIX_HEX)))
    parted = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    labels = F.split("host", r"\.")
    suffixes = F.array_distinct(F.filter(F.array(*[
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in row.label_counts]), lambda h: h.isNotNull()))
    prefixes = F.filter(F.array(*[
        F.when(F.char_length("path") >= n, F.left("path", F.lit(n))) for n in row.path_lengths]), lambda p: p.isNotNull())
    if not row.path_lengths:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    asked = (parted.select("host", "path").distinct()
             .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
             .withColumn("asked", digest(F.col("suffix"), F.col("prefix"))))
    fits = asked.join(keyed, F.left("asked", F.lit(PREFIX_HEX)) == F.col("short")).where(F.col("asked") == F.col("full"))
    rank = F.struct(F.char_length(F.concat("rule_host", "rule_path")), F.char_length("rule_host"), "rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "found"), rank).alias("best")).alias("best")
    same = (F.col("page.host") == F.col("best.host")) & (F.col("page.path") == F.col("best.path"))
    return parted.alias("page").join(best, same, "left").select(
        "page.*", F.col("best.best.rule").alias("rule"), F.coalesce("best.best.found", F.lit(default)).alias("verdict"))
