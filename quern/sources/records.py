"""Record sources: header files, multi-record text, JSON pages, local HTML, seeds, weather blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import dates, html
from quern.schemas import PAGE_JSON


def _header(head: Column, key: str) -> Column:
    """The last value of a header, trimmed; null without one."""
    return F.trim(F.try_element_at(_headers(head, key), F.lit(-1)))


def _headers(head: Column, key: str) -> Column:
    found = F.regexp_extract_all(head, F.lit(rf"(?im)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: F.trim(x)))


def parse_records(raw: DataFrame, value: str = "value") -> DataFrame:
    """Records of header blocks: keys in either case until the first blank line, then the text.

    ``image`` holds a url, a tab and its alt; a record without url is dropped; an empty title is the url.
    ``form`` says how ``sinks.record_text`` wrote a text that would be changed here.
    """
    text = F.regexp_replace(F.col(value), "\r\n?", "\n")
    parts = F.split(text, "\n[ \t]*\n", 2)
    head, body = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    none = F.array().cast("array<string>")
    pictures = F.transform(F.coalesce(_headers(head, "image"), none), lambda x: F.struct(F.trim(F.substring_index(x, "\t", 1)).alias("url"), F.when(F.contains(x, F.lit("\t")), F.trim(F.regexp_replace(x, "^[^\t]*\t", ""))).otherwise("").alias("alt")))
    url = F.coalesce(_header(head, "url"), F.lit(""))
    links = F.filter(F.coalesce(_headers(head, "links?"), none), lambda x: x != "")
    title = F.coalesce(F.nullif(_header(head, "title"), F.lit("")), url)
    plain, form = F.regexp_replace(body, r"^\s+|\s+$", ""), F.coalesce(_header(head, "form"), F.lit(""))
    quoted = (form == "quoted") & (F.length(plain) >= 2) & plain.startswith('"') & plain.endswith('"')
    bare = F.replace(F.replace(F.substr(plain, F.lit(2), F.length(plain) - 2), F.lit("\\r"), F.lit("\r")), F.lit("\\b"), F.lit("\\"))
    kept = F.when(quoted, bare).when((form == "none") & (plain == ""), F.lit(None)).otherwise(plain)
    rows = raw.select(url.alias("url"), title.alias("title"), kept.alias("text"), links.alias("links"), F.filter(pictures, lambda p: p["url"] != "").alias("images"), dates.parse_published(F.coalesce(_header(head, "published"), F.lit(""))).alias("published"))
    return rows.where("url <> ''")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ``.doc`` files of a folder."""
    return parse_records(spark.read.text(folder, wholetext=True, pathGlobFilter="*.[dD][oO][cC]"))


def split_records(bodies: DataFrame, value: str = "body") -> DataFrame:
    """The records of texts that hold several, between lines of ``---``."""
    return parse_records(bodies.select(F.explode(F.split(F.col(value), "\n---\n")).alias("value")))


def json_pages(bodies: DataFrame, value: str = "body") -> DataFrame:
    """url, title, text, published of the page objects in JSON texts, one object or an array each.

    Fields that are no strings, other elements and texts that are no JSON are passed over.
    """
    body = F.trim(F.col(value))
    array = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).when(body.startswith("["), body)
    raw = F.from_json(array, "array<string>", {"mode": "PERMISSIVE"})
    one = F.filter(F.transform(raw, lambda x: F.when(F.trim(x).startswith("{"), x)), lambda x: x.isNotNull())
    field = lambda x, k: F.when(F.coalesce(F.regexp_count(x, F.lit(rf'"{k}"\s*:\s*"')), F.lit(0)) > 0, F.get_json_object(x, f"$.{k}"))
    keys = [f.split(":")[0] for f in PAGE_JSON.removeprefix("array<struct<").split(",")]
    rows = bodies.select(F.explode(one).alias("x")).select(*(field(F.col("x"), k).alias(k) for k in keys))
    title = F.coalesce(F.nullif("title", F.lit("")), "url")
    return rows.where("url is not null and url <> ''").select("url", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"), dates.parse_published(F.coalesce("published", F.lit(""))).alias("published"))


def json_field(text: Column, key: str) -> Column:
    """The first string value of ``key`` anywhere in a JSON text; null without one."""
    return F.nullif(F.regexp_extract(text, rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*+)"', 1), F.lit(""))


def local_html(spark: SparkSession, folder: str) -> DataFrame:
    """url, title, text of the .html and .htm files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{html,htm}").select("value", F.col("_metadata.file_path").alias("path"))
    stem = F.regexp_extract("path", r"([^/]+)\.html?$", 1)
    url = F.concat(F.lit("file://"), F.regexp_replace("path", r"^file:/*", "/"))
    return files.select(url.alias("url"), html.local_title(F.col("value"), stem).alias("title"), html.local_text(F.col("value")).alias("text"))


def seeds(lines: DataFrame, value: str = "value") -> DataFrame:
    """url: one a line, without # comments and blank lines."""
    return lines.select(F.trim(F.regexp_replace(F.col(value), "#.*", "")).alias("url")).where("url <> ''")


# The keys of a weather block and the column each gives.
WEATHER_KEYS = {"location": "location", "place": "location", "alias": "aliases", "aliases": "aliases", "temp": "temperature", "temperature": "temperature", "condition": "condition", "summary": "condition", "feels_like": "feels_like", "feels like": "feels_like", "humidity": "humidity", "wind": "wind", "updated": "updated", "observed": "updated", "source": "source"}


def weather(files: DataFrame, value: str = "value") -> DataFrame:
    """Weather records: blocks of ``key: value`` lines between blank lines; place and temperature are needed."""
    blocks = files.select(F.posexplode(F.split(F.regexp_replace(F.col(value), "\r\n?", "\n"), "\n\n")).alias("record_id", "block"))
    column = lambda name: F.coalesce(F.trim(F.try_element_at(F.regexp_extract_all("block", F.lit(rf"(?im)^[ \t]*(?:{'|'.join(k for k, v in WEATHER_KEYS.items() if v == name)})[ \t]*:(.*)$"), F.lit(1)), F.lit(-1))), F.lit(""))
    names = list(dict.fromkeys(WEATHER_KEYS.values()))
    rows = blocks.select("record_id", *(column(n).alias(n) for n in names))
    aliases = F.filter(F.transform(F.split("aliases", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("aliases", aliases).where("location <> '' and temperature <> ''")
