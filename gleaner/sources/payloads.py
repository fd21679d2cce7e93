"""Landed feed and API payloads to item rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import content_hash, strip_tags
from ..operators.ranking import latest_per_key, top_per_group

# Fields of an RSS <item> and an Atom <entry>; namespace prefixes are dropped by the reader.
ENTRY_SCHEMA = (
    "title string, link array<struct<_href:string,_rel:string,_VALUE:string>>, description string, encoded string, "
    "summary string, content array<struct<_type:string,_VALUE:string>>, creator string, "
    "author struct<name:string,_VALUE:string>, pubDate string, published string, updated string"
)
XML_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}


def publish_time(raw: Column) -> Column:
    """ISO 8601 or RFC 822 time, in UTC; null when neither."""
    text = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")],
        F.expr("NULL").cast("timestamp"), F.try_to_timestamp(text))


def entry_items(entries: DataFrame, feed_id: Column) -> DataFrame:
    """Entry fields to item rows; entries without link or title are dropped."""
    links = F.col("link")
    href = lambda l: F.coalesce(l["_href"], F.trim(l["_VALUE"]))
    alternate = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(href(F.try_element_at(alternate, F.lit(1))), href(F.try_element_at(links, F.lit(1))))
    html = lambda c: F.coalesce(c["_type"], F.lit("")).isin("html", "text/html", "xhtml", "application/xhtml+xml")
    htmls = F.filter("content", html)
    texts = F.filter("content", lambda c: ~html(c))
    content_html = F.coalesce(F.col("encoded"), F.try_element_at(htmls, F.lit(-1))["_VALUE"], F.lit(""))
    plain = F.coalesce(F.try_element_at(texts, F.lit(-1))["_VALUE"], F.lit(""))
    text = F.when(plain != "", plain).otherwise(F.coalesce("summary", "description", F.lit("")))
    return (
        entries.select(
            feed_id.alias("feed_id"), F.coalesce(link, F.lit("")).alias("source_url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
            F.trim(strip_tags(text)).alias("content_text"), content_html.alias("content_html"),
            F.coalesce("creator", "author.name", "author._VALUE").alias("author"),
            publish_time(F.coalesce("pubDate", "published")).alias("published_at"))
        .where("source_url <> '' and title <> ''")
    )


def read_feed(spark: SparkSession, path: str, feed_id: int, row_tag: str = "item") -> DataFrame:
    """Landed feed files; ``row_tag`` is ``item`` for RSS and ``entry`` for Atom. Large files are split by row tag."""
    entries = spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", row_tag).schema(ENTRY_SCHEMA).load(path)
    return entry_items(entries, F.lit(feed_id).cast("long"))


def parse_feed(payloads: DataFrame, xml: str, feed_id: str = "feed_id") -> DataFrame:
    """The same for a table holding one entry document per row."""
    entry = F.from_xml(xml, ENTRY_SCHEMA, XML_OPTIONS)
    # as a generator the entry is parsed once: in a plain column the filters on link and title would each parse it again
    return entry_items(payloads.select(feed_id, F.inline_outer(F.array(entry))), F.col(feed_id))


def _field(doc: Column, paths: str | Sequence[str]) -> Column:
    """First non-empty value of the paths (dotted, below the item)."""
    names = [paths] if isinstance(paths, str) else list(paths)
    values = [F.try_variant_get(doc, f"$.{p}", "string") for p in names]
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


DEFAULT_MAPPER = {"title": "title", "url": "url", "author": "by", "time": "time", "content": "content"}


def map_items(docs: DataFrame, doc: str, mapper: Mapping[str, str | Sequence[str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """JSON documents (variant column) to item rows.

    Times are epoch seconds or ISO text. Without a url the id, the html_url or the title takes its place.
    """
    paths = {**DEFAULT_MAPPER, **(mapper or {})}
    v = F.col(doc)
    title = _field(v, paths["title"])
    time = _field(v, paths["time"])
    url = [F.when(c != "", c) for c in (_field(v, paths["url"]), _field(v, "id"), _field(v, "html_url"))]
    named = F.when(title != "", title).otherwise(F.lit("(no title)"))
    numeric = time.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return docs.select(
        *keep, F.coalesce(*url, named).alias("source_url"), named.alias("title"), _field(v, paths["content"]).alias("content_text"),
        _field(v, paths["author"]).alias("author"),
        F.when(numeric, F.timestamp_seconds(F.when(numeric, time).cast("double"))).otherwise(F.try_to_timestamp(time)).alias("published_at"))


def explode_items(payloads: DataFrame, raw: str, items_path: str = "$", keep: Sequence[str] = ()) -> DataFrame:
    """Documents of JSON payloads: the array (or the single object) at ``items_path``; broken payloads give none."""
    at = F.try_variant_get(F.try_parse_json(raw), items_path, "variant")
    many = F.try_variant_get(at, "$", "array<variant>")
    one = F.when(F.schema_of_variant(at).startswith("OBJECT"), F.array(at))
    docs = payloads.select(*keep, F.explode(F.coalesce(many, one)).alias("doc"))
    return docs.where(F.schema_of_variant("doc").startswith("OBJECT"))


def read_api(spark: SparkSession, path: str, mapper: Mapping[str, str | Sequence[str]] | None = None, items_path: str = "$") -> DataFrame:
    """Landed JSON responses, one file each."""
    return map_items(explode_items(spark.read.text(path, wholetext=True), "value", items_path), "doc", mapper)


def explode_ids(payloads: DataFrame, ids: str = "ids", key: str = "feed_id") -> DataFrame:
    """Id lists of responses as rows ``(key, pos, id)``."""
    return payloads.select(key, F.posexplode(ids).alias("pos", "id"))


def api_details(ids: DataFrame, details: DataFrame, max_items: int = 50) -> DataFrame:
    """First ``max_items`` ids ``(key, pos, id)`` of every list with their ``details (id, ...)``; missing ones are skipped."""
    return ids.where(F.col("pos") < max_items).join(details, "id")


def skip_unchanged(payloads: DataFrame, seen: DataFrame, url: str = "url", body: str = "body", order: str = "seq") -> DataFrame:
    """Payloads whose hash differs from the last one stored for their url."""
    last = latest_per_key(seen.select(url, order, content_hash(F.col(body)).alias("payload_hash")), [url], [order])
    hashed = payloads.withColumn("payload_hash", content_hash(F.col(body)))
    return hashed.join(last.select(url, "payload_hash"), [url, "payload_hash"], "left_anti").select(*payloads.columns, "payload_hash")


def enabled_feeds(feeds: DataFrame, env: str, name: str | None = None) -> DataFrame:
    out = feeds.where(F.col("enabled") & (F.col("env") == env))
    return out if name is None else out.where(F.col("name") == name)


def limit_per_feed(items: DataFrame, n: int, order: Sequence[str] = ("item_no",)) -> tuple[DataFrame, DataFrame]:
    """First ``n`` items per feed, and ``(feed_id, dropped)`` for feeds that had more."""
    kept = top_per_group(items, ["feed_id"], [F.col(c) for c in order], n).drop("rank")
    dropped = items.groupBy("feed_id").agg((F.count("*") - n).alias("dropped")).where("dropped > 0")
    return kept, dropped
