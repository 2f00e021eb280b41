"""Feeds (RSS, Atom, sitemaps, sitemap indexes) and robots.txt as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import dates, html, urls

ELEMENT = r"(?is)<((?:\w+:)?{0})\b[^>]*>(.*?)</\1\s*>"
DATES = "pubdate|lastmod|updated|published|date"


def _plain(text: Column) -> Column:
    return F.trim(html.decode_entities(F.regexp_replace(text, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")))


def _blocks(body: Column, name: str) -> Column:
    return F.regexp_extract_all(body, F.lit(ELEMENT.format(name)), F.lit(2))


def entries(feeds: DataFrame) -> DataFrame:
    """base_url, url, published of the entries of feeds (base_url, body); the first of equal urls of a feed.

    Relative urls are resolved, others than http(s) dropped. Dates come out in RFC 3339 and UTC where
    they can be read, else as they are. Broken markup loses the entries it breaks, not the feed.
    """
    body = F.col("body")
    rss = F.transform(_blocks(body, "item"), lambda b: F.struct(b.alias("b"), F.regexp_extract(b, ELEMENT.format("link"), 2).alias("u")))
    alternate = r"""(?is)(<(?:\w+:)?link\b(?![^>]*\brel\s*=\s*["'](?!alternate["']))[^>]*\bhref\s*=[^>]*>)"""
    atom = F.transform(_blocks(body, "entry"), lambda b: F.struct(b.alias("b"), html.attribute(F.regexp_extract(b, alternate, 1), "href").alias("u")))
    site = F.transform(_blocks(body, "url"), lambda b: F.struct(b.alias("b"), F.regexp_extract(b, ELEMENT.format("loc"), 2).alias("u")))
    rows = feeds.select("base_url", F.posexplode(F.concat(rss, atom, site)).alias("i", "e"))
    url = urls.resolve(F.col("base_url"), F.nullif(_plain(F.col("e.u")), F.lit("")))
    when = F.regexp_extract("e.b", ELEMENT.format(f"(?:{DATES})"), 2)
    found = rows.select("base_url", "i", url.alias("url"), dates.feed_date(_plain(when)).alias("published")).where("url is not null")
    return found.groupBy("base_url", "url").agg(F.min_by("published", "i").alias("published"), F.min("i").alias("i"))


def nested(feeds: DataFrame) -> DataFrame:
    """base_url, url of the sitemaps that a sitemap index names."""
    found = F.transform(_blocks(F.col("body"), "sitemap"), lambda b: _plain(F.regexp_extract(b, ELEMENT.format("loc"), 2)))
    rows = feeds.select("base_url", F.explode(F.array_distinct(found)).alias("u"))
    return rows.select("base_url", urls.resolve(F.col("base_url"), F.nullif("u", F.lit(""))).alias("url")).where("url is not null").distinct()


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """host, kind (allow, disallow, crawl-delay), value: the group of robots (host, body) for an agent.

    Consecutive user-agent lines share a group. The first group that names the agent counts, else the last for ``*``.
    """
    token = agent.split("/")[0].lower()
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("i", "line"))
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    fields = lines.select("host", "i", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"), line.alias("l")).where("l like '%:%' and key in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    by_line = Window.partitionBy("host").orderBy("i")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_line), F.lit("")) != "user-agent")
    grouped = fields.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(by_line)).where("g > 0")
    agents = grouped.where("key = 'user-agent'").groupBy("host").agg(F.min(F.when(F.lower("value") == token, F.col("g"))).alias("own"), F.max(F.when(F.col("value") == "*", F.col("g"))).alias("any"))
    chosen = agents.select("host", F.coalesce("own", "any").alias("g")).where("g is not null")
    return grouped.where("key <> 'user-agent'").join(chosen, ["host", "g"]).select("host", F.col("key").alias("kind"), "value")


def permitted(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, permitted: the longest prefix decides, allow on ties; without rules all is permitted."""
    asked = paths.select("host", "path").distinct().withColumn("p", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    prefixes = rules.where("kind in ('allow', 'disallow') and (kind = 'allow' or value <> '')")
    hit = asked.join(prefixes, "host", "left").groupBy("host", "path")
    longest = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & F.col("p").startswith(F.col("value")), F.octet_length("value"))), F.lit(-1))
    return hit.agg((longest("allow") >= longest("disallow")).alias("permitted"))


def frontier(found: DataFrame, visited: DataFrame, hosts: DataFrame, per_host: int, most: int) -> DataFrame:
    """The next urls to fetch: of allowed hosts, not visited, ``per_host`` of each host, ``most`` in all.

    found: url, seen (order of discovery); visited: url; hosts: host.
    """
    fresh = found.select(urls.crawl_form(F.col("url")).alias("url"), "seen").where("url is not null").groupBy("url").agg(F.min("seen").alias("seen"))
    fresh = fresh.withColumn("host", urls.url_host(F.col("url"))).join(hosts.select("host").distinct(), "host", "left_semi").join(visited.select("url"), "url", "left_anti")
    ranked = fresh.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("seen", "url"))).where(F.col("n") <= per_host)
    return ranked.orderBy("seen", "url").limit(most).select("url", "host", "seen")


def with_hints(pages: DataFrame, entries_: DataFrame) -> DataFrame:
    """pages with ``published`` filled from feed entries where the page has none."""
    hints = entries_.groupBy("url").agg(F.min("published").alias("hint"))
    return pages.join(hints, "url", "left").withColumn("published", F.coalesce(F.nullif("published", F.lit("")), "hint")).drop("hint")
