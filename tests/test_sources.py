"""Sources, sinks, streams and evaluation on fixtures."""

import json

from pyspark.sql import functions as F

from quern.functions import html, urls
from quern.functions import text as T
from quern.operators import evaluate, links
from quern.sources import records, sinks
from quern.streaming import ingest


def test_record_round_trip(spark, tmp_path):
    rows = [("https://x.org/a", "A", "some text\n\nmore", ["https://x.org/b"], [("https://x.org/i.png", "alt")], 1704153600)]
    df = spark.createDataFrame(rows, "url string, title string, text string, links array<string>, images array<struct<url:string,alt:string>>, published long")
    sinks.write_records(df, str(tmp_path / "store"))
    back = records.parse_records(spark.read.text(str(tmp_path / "store"), wholetext=True, recursiveFileLookup=True)).collect()
    assert len(back) == 1 and back[0].asDict(True) == df.collect()[0].asDict(True)


def test_read_store_and_local_html(spark, tmp_path):
    (tmp_path / "a.doc").write_text("url: u1\ntitle: T\n\nbody")
    (tmp_path / "b.DOC").write_text("title: no url\n\nbody")
    (tmp_path / "c.html").write_text("<title>Page</title><script>x</script><p>Hello  <b>world</b></p>")
    (tmp_path / "d.htm").write_text("<p>plain</p>")
    assert [r.url for r in records.read_store(spark, str(tmp_path)).collect()] == ["u1"]
    pages = {r.title: r.text for r in records.local_html(spark, str(tmp_path)).collect()}
    assert pages == {"Page": "Hello world", "d": "plain"}


def test_extraction_prefers_content(spark):
    page = "<title>T</title><nav class='menu'>Home News</nav><main><h1>Head</h1><p>" + "real words here " * 10 + "</p><pre><code>let x = 1;</code></pre></main><footer>end</footer>"
    text = spark.createDataFrame([(page,)], "h string").select(html.readable_text(F.col("h")).alias("t")).first().t
    assert text.startswith("Head real words") and "let x = 1;" in text and "Home" not in text and "end" not in text


def test_resolve(spark):
    base = "http://x.org/a/b/c?q#f"
    cases = {"d": "http://x.org/a/b/d", "/d": "http://x.org/d", "../d": "http://x.org/a/d", "./": "http://x.org/a/b/", "//y.org/z": "http://y.org/z", "?k=1": "http://x.org/a/b/c?k=1", "mailto:a@b": None, "https://z.org/#top": "https://z.org/", "../../../../d": "http://x.org/d"}
    got = spark.createDataFrame(list(cases), "string").select("value", urls.resolve(F.lit(base), F.col("value")).alias("u")).collect()
    assert {r.value: r.u for r in got} == cases


def test_versions_and_orphans(spark, tmp_path):
    root = str(tmp_path / "index")
    for n in (1, 2):
        sinks.save_tables({"t": spark.range(n)}, root)
    assert sinks.load_tables(spark, root)["t"].count() == 2
    assert sinks.drop_orphans(spark, root) == 1 and sinks.load_tables(spark, root)["t"].count() == 2


def test_stream_ingest_skips_known_urls_and_repeated_batches(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "index")
    drop.mkdir()
    (drop / "1.doc").write_text("url: u1\ntitle: One\n\nalpha")
    ingest.ingest_stream(spark, str(drop), root, str(tmp_path / "cp")).awaitTermination(120)
    (drop / "2.doc").write_text("url: u2\ntitle: Two\n\nbeta")
    (drop / "3.doc").write_text("url: u1\ntitle: Changed\n\ngamma")
    ingest.ingest_stream(spark, str(drop), root, str(tmp_path / "cp")).awaitTermination(120)
    docs = spark.read.parquet(f"{root}/documents")
    assert {(r.url, r.title) for r in docs.collect()} == {("u1", "One"), ("u2", "Two")}
    again = records.parse_records(spark.createDataFrame([("url: u2\n\nbeta",)], "value string"))
    assert ingest.ingest_batch(spark, root, again, 1) == {"received": 1, "added": 1, "skipped": 0}
    assert spark.read.parquet(f"{root}/documents").count() == 2
    assert ingest.dry_run(spark, root, again) == {"received": 1, "added": 0, "skipped": 1}


def test_pagerank(spark):
    nodes = spark.range(3).withColumnRenamed("id", "doc_id")
    ranks = {r.doc_id: r.rank for r in links.pagerank(nodes, spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "src long, dst long")).collect()}
    assert ranks[2] > ranks[0] > ranks[1] and abs(sum(ranks.values()) - 1) < 1e-9


def test_passages(spark):
    text = " ".join(map(str, range(1, 1001)))
    d = spark.createDataFrame([(text,), ("",), ("  ",)], "t string")
    got = [r[0] for r in d.select(T.passages(F.col("t"))).collect()]
    assert len(got[0]) == 6 and got[0][1].startswith("151 152") and got[1] == got[2] == []
    lapped = d.select(T.passages(F.col("t"), 150, 6, 30)).first()[0]
    assert lapped[1].startswith("121 122") and lapped[1].split()[29] == "150"


def test_evaluation_and_json(spark):
    r = spark.createDataFrame([(0, 1, "https://a.org/x"), (0, 2, "https://b.org/y")], "query_id long, rank int, url string")
    g = evaluate.graded(r, spark.createDataFrame([(0, "b.org", 3)], "query_id long, url_pattern string, grade int"))
    s = evaluate.scores(g).collect()[0]
    assert abs(s.ndcg - 1 / 1.584962500721156) < 1e-9 and s.success == 1 and s.first_good == 2
    hits = spark.createDataFrame([(0, 1, "u", "t", 0.5, None, [], 0, None)], "query_id long, rank int, url string, title string, score double, answer string, images array<struct<url:string,alt:string>>, published long, fresh_label string")
    assert json.loads(sinks.json_hits(hits).first().json) == [{"url": "u", "title": "t", "score": "0.50000"}]


def test_snippet_window_and_escape(spark):
    words = ["pad"] * 40 + ["<hit>", "x"]
    d = spark.createDataFrame([(" ".join(words),)], "t string")
    got = d.select(T.snippet(F.col("t"), F.array(F.lit("hit")))).first()[0]
    assert got.startswith("… ") and "<mark>&lt;hit&gt;</mark>" in got and got.count("pad") == 31
