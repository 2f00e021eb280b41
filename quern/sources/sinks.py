"""Sinks: record files, the index as Parquet with a manifest, JSON results, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import html_escape, percent_encode


def record_name(url: Column) -> Column:
    """The file name of a record: the first 16 hex digits of the url's SHA-256."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".doc"))


def record_text(record: str = "") -> Column:
    """A record as its header block and text.

    A text that readers would change, with white space at an end or carriage returns, is written in quotes under
    ``form: quoted``, with \\b for a backslash and \\r for a return; a null text is ``form: none``.
    """
    col = lambda c: F.col(f"{record}{c}")
    lines = F.concat(F.array(F.concat(F.lit("url: "), col("url")), F.concat(F.lit("title: "), F.regexp_replace(col("title"), "[\r\n]+", " ")), F.when(col("published") > 0, F.concat(F.lit("published: "), F.date_format(F.date_from_unix_date((col("published") / 86400).cast("int")), "yyyy-MM-dd")))), F.transform(col("images"), lambda x: F.concat(F.lit("image: "), x["url"], F.lit("\t"), x["alt"])), F.transform(col("links"), lambda x: F.concat(F.lit("link: "), x)))
    text = col("text")
    odd = text.rlike(r"^\s|\s$|\r")
    form = F.when(text.isNull(), "form: none").when(odd, "form: quoted")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
    head = F.array_join(F.filter(F.concat(lines, F.array(form)), lambda x: x.isNotNull()), "\n")
    return F.concat(head, F.lit("\n\n"), F.when(odd, quoted).otherwise(F.coalesce(text, F.lit(""))))


def write_records(records: DataFrame, folder: str) -> None:
    """One folder a record name, each holding its text; ``read_store`` reads them with recursive look-up."""
    records.select(record_name(F.col("url")).alias("name"), record_text().alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the manifests, the current one last."""
    fs, top = _files(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(n for n in found if n.startswith("_manifest-"))


def _manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/{_manifests(spark, root)[-1]}").first()[0])


def save_tables(tables: dict[str, DataFrame], root: str) -> str:
    """Write an index version and make it current by a manifest with the next number.

    Tables go to a folder of their own that no reader knows before a manifest names it, and no manifest is
    ever moved away: readers see the old version or the new one, never none and never a mixture. Of two
    writers with the same number one finds it taken and goes on to the next. Returns the version's name.
    """
    import uuid

    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    draft = f"{root}/_draft-{version}"
    spark.createDataFrame([(json.dumps({"version": version, "tables": sorted(tables)}),)], "value string").coalesce(1).write.text(draft)
    fs, source = _files(spark, draft)
    n = int((_manifests(spark, root) or ["_manifest-0"])[-1].rpartition("-")[2])
    while True:
        n += 1
        target = _files(spark, f"{root}/_manifest-{n:012d}")[1]
        if not fs.exists(target) and fs.rename(source, target):
            return version


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version; columns are read only as plans need them."""
    manifest = _manifest(spark, root)
    return {t: spark.read.parquet(f"{root}/{manifest['version']}/{t}") for t in manifest["tables"]}


def drop_orphans(spark: SparkSession, root: str) -> int:
    """Delete the versions that the current manifest does not name, and earlier manifests; returns how many versions went."""
    version, older = _manifest(spark, root)["version"], _manifests(spark, root)[:-1]
    fs, top = _files(spark, root)
    gone = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and not s.getPath().getName().startswith("_") and s.getPath().getName() != version]
    for p in [*gone, *(_files(spark, f"{root}/{n}")[1] for n in older)]:
        fs.delete(p, True)
    return len(gone)


PAGE_STYLE = "body{font:16px sans-serif;max-width:48rem;margin:2rem auto}li{margin:1rem 0}small{color:#555}mark{background:#fe9}"


def _page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{PAGE_STYLE}</style></head><body>"), body, F.lit("</body></html>"))


def results_page(hits: DataFrame, queries: DataFrame, corrected: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """query_id, html: a page of hits for each query (query_id, q), with a correction and further searches where given.

    Snippets are escaped already and keep their marks; all else is escaped here.
    """
    at = lambda c: F.coalesce(html_escape(F.col(c)), F.lit(""))
    label = F.coalesce(F.concat(F.lit(" · "), at("fresh_label")), F.lit(""))
    pictures = F.array_join(F.transform("images", lambda x: F.concat(F.lit('<img src="'), html_escape(x["url"]), F.lit('" alt="'), html_escape(x["alt"]), F.lit('">'))), "")
    item = F.concat(F.lit('<li><a href="'), at("url"), F.lit('">'), at("title"), F.lit("</a><br><small>"), at("url"), label, F.lit("</small><p>"), F.coalesce("snippet", F.lit("")), F.lit("</p>"), F.coalesce(pictures, F.lit("")), F.lit("</li>"))
    listed = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    rows = queries.select("query_id", "q").join(listed, "query_id", "left")
    one = lambda c: F.concat(F.lit('<a href="?q='), percent_encode(F.col(c), plus=True), F.lit('">'), at(c), F.lit("</a>"))
    if corrected is not None:
        rows = rows.join(corrected.select("query_id", F.concat(F.lit("<p>Did you mean "), one("corrected"), F.lit("?</p>")).alias("meant")), "query_id", "left")
    if related is not None:
        chips = related.select("query_id", F.struct("rank", one("q").alias("chip")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["chip"]), " ").alias("chips"))
        rows = rows.join(chips, "query_id", "left")
    part = lambda c, lead, end: F.coalesce(F.concat(F.lit(lead), F.col(c), F.lit(end)), F.lit("")) if c in rows.columns else F.lit("")
    body = F.concat(F.lit("<h1>"), at("q"), F.lit("</h1>"), part("meant", "", ""), F.coalesce(F.concat(F.lit("<ol>"), F.col("items"), F.lit("</ol>")), F.lit("<p>Nothing found.</p>")), part("chips", "<p>Related: ", "</p>"))
    return rows.select("query_id", _page(at("q"), body).alias("html"))


def dashboard_page(totals: DataFrame, queries: DataFrame, clicks: DataFrame, most: int = 8) -> DataFrame:
    """html: one row, a page of telemetry totals (one row), the first queries and the most clicked urls."""
    at = lambda c: html_escape(F.col(c).cast("string"))
    cells = lambda *cs: F.concat(F.lit("<tr><td>"), *(x for c in cs for x in (at(c), F.lit("</td><td>"))), F.lit("</td></tr>"))

    def table(df: DataFrame, order: list[Column], name: str, *cs: str) -> DataFrame:
        top = df.orderBy(*order).limit(most).agg(F.collect_list(F.struct(*(o for o in (F.col(cs[1]).alias("n"), F.col(cs[0]).alias("k"))), cells(*cs).alias("row"))).alias("x"))
        ordered = F.array_sort("x", lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        return top.select(F.array_join(F.transform(ordered, lambda r: r["row"]), "").alias(name))

    rows = totals.crossJoin(F.broadcast(table(queries, [F.desc("count"), F.asc("query")], "asked", "query", "count"))).crossJoin(F.broadcast(table(clicks, [F.desc("clicks"), F.asc("url")], "clicked", "url", "clicks")))  # a row each
    lines = F.concat(*(x for name, c in (("Searches", "searches"), ("Clicks", "clicks"), ("Without result", "zero_rate"), ("Mean ms", "avg_ms")) for x in (F.lit(f"<p>{name}: "), at(c), F.lit("</p>"))))
    return rows.select(_page(F.lit("Telemetry"), F.concat(F.lit("<h1>Telemetry</h1>"), lines, F.lit("<h2>Queries</h2><table>"), F.col("asked"), F.lit("</table><h2>Clicks</h2><table>"), F.col("clicked"), F.lit("</table>"))).alias("html"))


def json_hits(hits: DataFrame) -> DataFrame:
    """query_id, json: the hits of each query in order, without null fields, score with five decimals."""
    one = F.struct("rank", F.struct("url", "title", F.format_number("score", 5).alias("score"), "answer", F.when(F.size("images") > 0, F.col("images")).alias("images"), F.when(F.col("published") > 0, F.col("published")).alias("published"), "fresh_label").alias("hit"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["hit"])
    return hits.groupBy("query_id").agg(F.to_json(ordered).alias("json"))


def suggestion_list(q: Column, items: Column) -> Column:
    """The two-part suggestion answer: the prefix and the list of completions."""
    return F.concat(F.lit("["), F.to_json(F.struct(q.alias("q"))).substr(F.lit(6), F.length(F.to_json(F.struct(q.alias("q")))) - 6), F.lit(","), F.to_json(items), F.lit("]"))
