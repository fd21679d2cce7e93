"""Page cleaning, host classification and vector checks."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import (
    canonical_url, content_hash, scrub_html, squash, strip_tags, tokens, unescape, url_hash, url_host, word_count)
from ..session import small_side

# Elements that never hold article text, and class names of those that are not part of it.
NOISE_TAGS = ["nav", "header", "footer", "aside", "form", "noscript", "template", "svg"]
NOISE_CLASSES = {"ad", "ads", "advert", "cookie", "share", "sidebar"}
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-z][\w-]*)([^>]*)>", re.I | re.S)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _is_noise(name: str, attributes: str) -> bool:
    """Whether a start tag begins a noise element."""
    if name in NOISE_TAGS:
        return True
    found = CLASS.search(attributes) if name == "div" else None
    return found is not None and not NOISE_CLASSES.isdisjoint("".join(g or "" for g in found.groups()).lower().split())


def without_noise(html: str) -> str:
    """``html`` without comments and noise elements, each up to the end tag that closes it; one pass over the tags.

    An element is noise by its name, or if it is a div with a noise class among its classes. One that is never closed
    hides nothing but its own tag.
    """
    out, at, skip = [], 0, None  # skip: name, depth and place of the noise element we are in
    tags = list(TAG.finditer(html))
    i = 0
    while i < len(tags):
        tag = tags[i]
        name = (tag[2] or "").lower()
        if skip is not None:
            if name == skip[0] and not tag[3].endswith("/"):
                skip[1] += -1 if tag[1] else 1
                if skip[1] == 0:
                    at, skip = tag.end(), None
        elif not name:
            out.append(html[at:tag.start()])
            at = tag.end()
        elif not tag[1] and _is_noise(name, tag[3]):
            out.append(html[at:tag.start()])
            at = tag.end()
            if not tag[3].endswith("/"):
                skip = [name, 1, i]
        i += 1
        if i == len(tags) and skip is not None:  # never closed: go on behind its tag
            i, skip = skip[2] + 1, None
    out.append(html[at:])
    return "".join(out)


@F.pandas_udf(StringType())
def article_markup(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else without_noise(h))


def with_url_hash(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("canonical_url", canonical_url(F.col(url))).withColumn("url_hash", url_hash(F.col(url)))


def with_content_hash(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col(text)))


def with_word_count(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("word_count", word_count(F.col(text)))


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text)))


def with_scrubbed(df: DataFrame, html: str, max_bytes: int | None = None) -> DataFrame:
    return df.withColumn(html, scrub_html(F.col(html), max_bytes))


def main_html(html: Column) -> Column:
    """The article (else main, else body) element without comments, navigation and advertising blocks."""
    out = article_markup(html)
    article, main, body = (F.regexp_extract(out, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1) for tag in ("article", "main", "body"))
    bare = F.regexp_replace(out, r"(?is)<(head|title)\b.*?</(head|title)>", "")
    return F.when(article != "", article).when(main != "", main).when(out.rlike(r"(?i)<body\b"), body).otherwise(bare)


def tidy(text: Column) -> Column:
    """References resolved, blanks collapsed inside lines, empty lines dropped."""
    lines = F.transform(F.split(unescape(text), "\n"), squash)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_text(main: Column) -> Column:
    """Plain text, one line per block element."""
    broken = F.regexp_replace(F.regexp_replace(main, r"\s+", " "), r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|blockquote|section|pre)\b[^>]*>", "\n")
    return tidy(strip_tags(broken))


def html_markdown(main: Column) -> Column:
    """Markdown with headings, list items and links."""
    out = F.regexp_replace(main, r"\s+", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|blockquote|section|pre)\b[^>]*>", "\n")
    return tidy(strip_tags(out))


def html_title(html: Column) -> Column:
    return squash(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def clean_pages(pages: DataFrame, html: str = "html", title: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Adds title, content_text, content_md, is_parseable and word_count; the title stands in for an empty text."""
    scrubbed = pages.withColumn("_html", scrub_html(F.col(html), max_bytes))
    named = scrubbed.withColumn("title", F.col(title) if title else html_title(F.col("_html"))).withColumn("_main", main_html(F.col("_html")))
    text, md = html_text(F.col("_main")), html_markdown(F.col("_main"))
    out = named.withColumn("content_text", text).withColumn("content_md", md)
    empty = (F.col("content_text") == "") & (F.coalesce("title", F.lit("")) != "")
    return (
        out.withColumn("content_md", F.when(empty, F.concat(F.lit("# "), "title")).otherwise(F.col("content_md")))
        .withColumn("content_text", F.when(empty, F.col("title")).otherwise(F.col("content_text")))
        .withColumn("is_parseable", F.trim("content_text") != "")
        .withColumn("word_count", F.when(F.col("is_parseable"), word_count(F.col("content_text"))).otherwise(F.lit(0).cast("long")))
        .drop("_html", "_main")
    )


def boilerplate_lines(pages: DataFrame, key: str, url: str, text: str, min_pages: int = 3) -> DataFrame:
    """``(host, line)`` found on at least ``min_pages`` pages of a host."""
    lines = pages.select(key, url_host(F.col(url)).alias("host"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "line")


def drop_boilerplate(pages: DataFrame, key: str, url: str, text: str, min_pages: int = 3) -> DataFrame:
    """Lines repeated over the pages of a host removed from ``text``; order of the other lines kept."""
    common = boilerplate_lines(pages, key, url, text, min_pages)
    lines = pages.select(key, url_host(F.col(url)).alias("host"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    kept = lines.join(common, ["host", "line"], "left_anti").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("no", "line"))).alias("l")).select(
        key, F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("_kept"))
    return pages.join(kept, key, "left").withColumn(text, F.coalesce("_kept", F.lit(""))).drop("_kept")


QUAD = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
# Loopback, private, link-local and otherwise special IPv4 ranges as (first address, prefix length).
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29),
    ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4),
]


@F.pandas_udf(BooleanType())
def private_v6(hosts: pd.Series) -> pd.Series:
    """Whether an IPv6 address, in any spelling, is of a private, loopback or link-local range; IPv4 inside it counts. Else null."""

    def judged(host: str | None) -> bool | None:
        try:
            address = ipaddress.IPv6Address(host.strip("[]").partition("%")[0])
        except (AttributeError, ValueError):
            return None
        inner = address.ipv4_mapped or address
        return inner.is_private or inner.is_loopback or inner.is_link_local

    return hosts.map(judged).astype("boolean")


def _private_number(number: Column) -> Column:
    inside = F.lit(False)
    for base, bits in PRIVATE_V4:
        a, b, c, d = (int(x) for x in base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    return F.coalesce(inside, F.lit(False))


def _quad_number(quad: Column) -> Column:
    octet = lambda i: F.element_at(F.split(quad, r"\."), i).cast("long")
    return ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)


def is_private_host(host: Column) -> Column:
    """localhost, or an address of a private, loopback, link-local or otherwise special range, IPv4 in IPv6 among them."""
    quad = F.when(host.rlike(f"^{QUAD}$"), _quad_number(host))
    v6 = private_v6(F.when(host.contains(":"), host))
    return (host == "") | (host == "localhost") | host.endswith(".localhost") | _private_number(quad) | F.coalesce(v6, F.lit(False))


def classify_hosts(df: DataFrame, url: str, allowed: DataFrame) -> DataFrame:
    """Adds host and host_class: private, allowed (listed host or subdomain of one) or blocked.

    Distinct hosts are exploded into their domain suffixes and looked up, so the list may be of any size and
    the urls themselves are joined once.
    """
    hosts = df.withColumn("host", url_host(F.col(url)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = hosts.select("host").distinct()
    ok = (
        names.select("host", F.explode(suffixes).alias("suffix"))
        .join(small_side(allowed.select(F.lower("host").alias("suffix"))), "suffix", "left_semi").select("host", F.lit(True).alias("ok")).distinct()
    )
    classes = names.join(ok, "host", "left").select("host", F.when(is_private_host(F.col("host")), "private").when(
        F.col("ok"), "allowed").otherwise("blocked").alias("host_class"))
    return hosts.join(classes, "host", "left").withColumn("host_class", F.coalesce("host_class", F.lit("blocked")))


def vector_text(articles: DataFrame, max_chars: int = 8192) -> DataFrame:
    """``(article_id, kind, text)`` to be embedded: the title, and the body cut to the model's input size."""
    return articles.select("article_id", F.inline(F.array(
        F.struct(F.lit("title").alias("kind"), F.col("title").alias("text")),
        F.struct(F.lit("body").alias("kind"), F.substring("content_text", 1, max_chars).alias("text")))))


def check_vectors(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the right dimension, and the rest."""
    ok = F.coalesce(F.size("vector") == dim, F.lit(False))
    return df.where(ok), df.where(~ok)
