"""RSS and Atom feeds as observation rows, parsed by Spark's XML reader functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RSS_ITEM = "struct<guid:string,link:string,title:string,pubDate:string,author:string,description:string>"
ATOM_ENTRY = "struct<id:string,link:struct<_href:string>,title:string,published:string,updated:string,author:struct<name:string>,summary:string>"


def parse_time(c: Column) -> Column:
    """RFC 822 and ISO 8601 times; null if unreadable."""
    plain = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(F.regexp_replace(plain, r"\b(?:GMT|UT|UTC|Z)$", "+0000"), r"([+-]\d{2}):(\d{2})$", "$1$2")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm xx")), F.try_to_timestamp(F.trim(c)))


def items(feeds: DataFrame, feed: str = "feed_url", body: str = "body", most: int | None = 50) -> DataFrame:
    """(feed, upstream_id, canonical_url, title, published_at, author, text) of the first ``most`` items of each feed; of all for None.

    Elements are cut out as text and read one by one, so a broken item costs only itself.
    """
    rss = F.regexp_extract_all(body, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))
    atom = F.regexp_extract_all(body, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))
    found = F.concat(rss, atom)
    cut = feeds.select(feed, F.posexplode(found if most is None else F.slice(found, 1, most)).alias("place", "xml"))
    # namespaced elements are of no use here and their prefixes are undeclared in a cut-out element
    plain = F.regexp_replace(F.regexp_replace("xml", r"(?s)<([a-zA-Z]+:[\w.-]+)\b[^>]*?(?:/>|>.*?</\1>)", ""), r"\s[a-zA-Z]+:[\w.-]+=\"[^\"]*\"", "")
    is_rss = F.col("xml").startswith("<item")
    options = {"rowTag": "item", "mode": "PERMISSIVE"}
    read = cut.select(feed, "place", is_rss.alias("is_rss"), F.from_xml(plain, RSS_ITEM, options).alias("r"), F.from_xml(plain, ATOM_ENTRY, {"rowTag": "entry", "mode": "PERMISSIVE"}).alias("a"))
    pick = lambda r, a: F.nullif(F.trim(F.when(F.col("is_rss"), r).otherwise(a)), F.lit(""))
    link = pick(F.col("r.link"), F.col("a.link._href"))
    return read.select(
        feed,
        "place",
        F.coalesce(pick(F.col("r.guid"), F.col("a.id")), link).alias("upstream_id"),
        link.alias("canonical_url"),
        pick(F.col("r.title"), F.col("a.title")).alias("title"),
        parse_time(pick(F.col("r.pubDate"), F.coalesce("a.published", "a.updated"))).alias("published_at"),
        pick(F.col("r.author"), F.col("a.author.name")).alias("author"),
        F.trim(F.regexp_replace(pick(F.col("r.description"), F.col("a.summary")), "<[^>]*>", " ")).alias("text"),
    )


def atom(entries: DataFrame, id: str, title: str, url: str, at: str) -> DataFrame:
    """Atom entry elements, one row each, ordered by the caller."""
    from quern.functions.text import escape_xml

    e = lambda c: escape_xml(F.col(c).cast("string"))
    return entries.select(F.concat(F.lit("<entry><id>"), e(id), F.lit("</id><title>"), e(title), F.lit('</title><link href="'), e(url), F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>")).alias("entry"))


def episodes(payloads: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Podcast episodes of JSON payloads {feed, episodes: [...]}: guid, title, seconds, audio address and kind.

    Durations come as seconds or as ``h:mm:ss``; an episode without an address has none of audio.
    """
    schema = "array<struct<guid:string,title:string,duration:string,enclosure:struct<url:string,type:string>>>"
    e = payloads.select(*keep, F.explode(F.from_json(F.get_json_object(payload, "$.episodes"), schema)).alias("e"))
    parts = F.transform(F.split("e.duration", ":"), lambda p: p.try_cast("int"))
    seconds = F.when(F.col("e.duration").rlike(r"^\d+(?::\d{1,2}){0,2}$"), F.aggregate(parts, F.lit(0), lambda acc, p: acc * 60 + p))
    return e.select(*keep, "e.guid", F.nullif(F.trim("e.title"), F.lit("")).alias("title"), seconds.alias("seconds"), F.col("e.enclosure.url").alias("audio"), F.col("e.enclosure.type").startswith("audio/").alias("is_audio"))


def paged(pages: DataFrame, feed: str, page: str, payload: str, items: str, cursor: str) -> DataFrame:
    """(feed, page, place, item, broken): the items of paged feeds in order, and whether the pages before are a whole chain.

    ``items`` and ``cursor`` are JSON paths to the list and to the cursor of the next page; a page is
    ``broken`` if one before it is missing or had no cursor to lead on.
    """
    rows = pages.select(feed, page, F.from_json(F.get_json_object(payload, items), "array<string>").alias("_items"), F.get_json_object(payload, cursor).alias("_next"))
    w = Window.partitionBy(feed).orderBy(page)
    led = F.when(F.lag(page).over(w).isNull(), F.col(page) == 0).otherwise((F.lag(page).over(w) == F.col(page) - 1) & F.lag("_next").over(w).isNotNull())
    marked = rows.withColumn("_led", led)
    marked = marked.withColumn("broken", F.min(F.col("_led").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0)
    return marked.select(feed, page, "broken", F.posexplode("_items").alias("place", "item"))
