"""Command line, merges, pruned ranking, approximate vectors, pages and streams."""

import random

import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.operators import index as I  # noqa: E741
from quern.operators import links, semantic, telemetry, verticals
from quern.operators import rank as R
from quern.plans import catalog
from quern.plans.search import Engine, Options
from quern.sources import records, sinks
from quern.streaming import ingest

DOCS = "doc_id long, url string, title string, text string"


def test_command_line(spark, tmp_path):
    store, root = tmp_path / "store", str(tmp_path / "index")
    store.mkdir()
    (store / "a.doc").write_text("url: https://a.org\ntitle: Rust book\n\nownership and borrowing")
    (store / "b.doc").write_text("url: https://b.org\ntitle: Go tour\n\nchannels")
    at = ["--index", root, "--store", str(store)]
    assert main(["build", *at, "--impacts"], spark) == {"documents": 2}
    assert "impacts" in sinks.load_tables(spark, root)
    assert [h["url"] for h in main(["search", *at, "--query", "borrowing"], spark)["hits"]] == ["https://a.org"]
    assert main(["search", *at, "--query", "zzz"], spark)["hits"] == []
    (store / "b.doc").write_text("url: https://b.org\ntitle: Go tour\n\nchannels and borrowing")
    (store / "c.doc").write_text("url: https://c.org\ntitle: C\n\nnew")
    assert main(["update", *at], spark) == {"unchanged": 1, "changed": 1, "added": 1}
    assert main(["update", *at], spark) == {"unchanged": 3}
    assert len(main(["search", *at, "--query", "borrowing"], spark)["hits"]) == 2
    assert main(["compact", *at], spark)["dropped"] == 2 and main(["stats", *at], spark)["documents"] == 3


def test_batches_are_merged_and_found_once(spark, tmp_path):
    root = str(tmp_path / "index")
    for i in range(4):
        r = records.parse_records(spark.createDataFrame([(f"url: u{i}\ntitle: T{i}\n\nalpha {i}",)], "value string"))
        ingest.ingest_batch(spark, root, r, i)
    assert ingest.health(spark, root) == {"ready": True, "documents": 4, "segments": 4} and not ingest.health(spark, str(tmp_path / "none"))["ready"]
    assert ingest.merge_due(spark, root, 3) == [0, 1, 2] and ingest.merge_due(spark, root, 3) == []
    assert {(r.segment_id, r.size) for r in ingest.segments(spark, root).collect()} == {(2, 3), (3, 1)}
    late = records.parse_records(spark.createDataFrame([("url: u9\ntitle: first\n\nx",), ("url: u9\ntitle: second\n\ny",)], "value string").coalesce(1))
    ingest.ingest_batch(spark, root, late, 7)
    # Another writer that had looked before this batch was there adds the same url.
    spark.read.parquet(f"{root}/documents/batch=7").withColumns({"doc_id": F.lit(99).cast("long"), "title": F.lit("rival")}).write.parquet(f"{root}/documents/batch=8")
    spark.read.parquet(f"{root}/postings/batch=7").withColumn("doc_id", F.lit(99).cast("long")).write.parquet(f"{root}/postings/batch=8")
    index = ingest.load_ingested(spark, root)
    assert sorted(r.title for r in index.documents.collect()) == ["T0", "T1", "T2", "T3", "first"]
    assert index.postings.where("doc_id = 99").count() == 0 and index.postings.where("term = 'alpha'").count() == 4


def test_pruned_ranking_is_exact(spark):
    rng = random.Random(3)
    words = ["the" + str(i % 3) for i in range(6)] + [f"w{i}" for i in range(40)]
    docs = [(i, f"u{i}", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(400)]
    ix = I.build(spark.createDataFrame(docs, DOCS))
    q = spark.createDataFrame([(n, t) for n in range(12) for t in rng.sample(words, 4)], "query_id long, term string")
    want = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in R.top(R.lexical(ix, R.matches(ix, q)), 5).collect()}
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in R.pruned_top(ix.impacts(), q, 5).collect()}
    assert got == want and len(want) == 60


def test_approximate_vectors_in_the_engine(spark, tmp_path):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, f"u{i}", f"t{i}", " ".join(rng.sample(words, 30))) for i in range(150)], DOCS)
    embed = semantic.hash_embedder(64)
    vectors = semantic.embedded(semantic.passages(docs), embed)
    semantic.save_ann(vectors, str(tmp_path / "ann"), 64, 40, 5)
    stored, buckets = semantic.load_ann(spark, str(tmp_path / "ann"))
    q = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 20), " ").alias("q"))
    first = lambda e, o: {r.query_id: r.doc_id for r in e.search(q, o).where("rank = 1").collect()}
    exact = first(Engine(I.build(docs, True), stored, embed), Options(k=5))
    near = first(Engine(I.build(docs, True), stored, embed, buckets), Options(k=5, approximate=True, tables=40, bits=5))
    assert sum(near[i] == exact[i] for i in exact) >= 0.95 * len(exact)


def test_recall_of_hashed_buckets(spark, data):
    rows = catalog.QUERIES["ann_lsh_recall"](spark, data).collect()
    assert sum(r.found for r in rows) >= 0.95 * sum(r.wanted for r in rows)


def test_pages_are_escaped(spark):
    hits = spark.createDataFrame([(0, 2, "https://b.org/?a=1&b", "B", None, [], None), (0, 1, "https://a.org", "A <b>", "x <mark>y</mark>", [("i.png", 'q"')], "News")], "query_id long, rank int, url string, title string, snippet string, images array<struct<url:string,alt:string>>, fresh_label string")
    q = spark.createDataFrame([(0, "a & b"), (1, "none")], "query_id long, q string")
    fixed = spark.createDataFrame([(1, "nine")], "query_id long, corrected string")
    more = spark.createDataFrame([(0, 2, "b c"), (0, 1, "a c")], "query_id long, rank int, q string")
    page = {r.query_id: r.html for r in sinks.results_page(hits, q, fixed, more).collect()}
    assert page[0].index("A &lt;b&gt;") < page[0].index("?a=1&amp;b") and "x <mark>y</mark>" in page[0] and 'alt="q&quot;"' in page[0] and " · News" in page[0]
    assert "<h1>a &amp; b</h1>" in page[0] and page[0].index("?q=a+c") < page[0].index("?q=b+c") and "Nothing found." in page[1] and "Did you mean" in page[1]
    searches = spark.createDataFrame([("<q>", 3), ("r", 5)], "query string, count long")
    clicks = spark.createDataFrame([("https://x.org", 2)], "url string, clicks long")
    totals = spark.createDataFrame([(8, 2, 0.5, 1.5)], "searches long, clicks long, zero_rate double, avg_ms double")
    board = sinks.dashboard_page(totals, searches, clicks).first().html
    assert "Searches: 8" in board and board.index("<td>r</td><td>5") < board.index("&lt;q&gt;") and "https://x.org</td><td>2" in board


def test_streams_over_events(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "Rust  book", 3, 10), ("2024-01-01 00:00:05", "rust book", 0, 20), ("2024-01-01 00:00:20", "!gh x", 1, 30), ("2024-01-01 02:00:00", "go", 1, 40)]
    spark.createDataFrame(rows, "ts string, q string, results int, elapsed_ms long").select(F.col("ts").cast("timestamp").alias("ts"), "q", "results", "elapsed_ms").write.parquet(str(tmp_path / "log"))
    log = lambda: spark.readStream.schema("ts timestamp, q string, results int, elapsed_ms long").parquet(str(tmp_path / "log"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    assert {(r["query"], r["count"]) for r in run(ingest.session_memory(log()), "remembered", "complete")} == {("rust book", 2), ("go", 1)}
    assert sorted((r.searches, r.zero, r.avg_ms) for r in run(ingest.search_totals(log()), "totals", "complete")) == [(1, 0, 40.0), (3, 1, 20.0)]
    assert sorted(r.n for r in run(ingest.bursts(log()), "bursts", "complete")) == [1, 3]


def test_missing_vectors_are_embedded(spark):
    docs = spark.createDataFrame([(0, "u0", "A", "one two"), (1, "u1", "B", "three")], DOCS)
    p = semantic.passages(docs)
    have = semantic.embedded(p.where("doc_id = 0"), semantic.hash_embedder(8)).withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    got = {r.doc_id: r.embedding for r in semantic.embed_missing(p, have, semantic.hash_embedder(8)).collect()}
    assert got[0] == [9.0] and len(got[1]) == 8


def test_limits_and_names(spark):
    assert [verticals.named(x) for x in ("News", " docs ", "x", None, "images", "sites")] == ["fresh", "docs", "all", "all", "images", "sites"]
    docs = spark.createDataFrame([(i, f"https://h{i}.org", "t", "alpha") for i in range(120)], DOCS)
    q = spark.createDataFrame([(0, "alpha")], "query_id long, q string")
    engine = Engine(I.build(docs))
    assert engine.search(q, Options(k=500)).count() == 100 and engine.search(q, Options(k=0)).count() == 1
    few = spark.createDataFrame([(i, [1.0, 0.0], float(i)) for i in range(5)], "doc_id long, embedding array<double>, rank double")
    assert {x for r in semantic.similarity_graph(few, 2, 99).collect() for x in (r.a, r.b)} == {3, 4}


def test_ranks_change_the_order(spark):
    docs = spark.createDataFrame([(0, "u0", "t", "alpha beta", 0.1), (1, "u1", "t", "alpha beta", 0.9)], DOCS + ", rank double")
    assert [r.doc_id for r in Engine(I.build(docs)).search(spark.createDataFrame([(0, "alpha")], "query_id long, q string")).orderBy("rank").collect()] == [1, 0]


def test_ranks_settle(spark):
    """The fixed number of rounds is enough: further rounds change nothing that counts."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(120)], "src long, dst long").where("src <> dst")
    nodes = spark.range(30).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r.rank for r in links.pagerank(nodes, edges, rounds=n).collect()} for n in (links.ROUNDS, 2 * links.ROUNDS))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


@pytest.mark.parametrize("gap, n", [(1, 3), (5, 2), (3600, 1)])
def test_lulls(spark, gap, n):
    e = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:03",), ("2024-01-01 00:01:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    assert telemetry.lulls(e, gap).count() == n


def test_sidecars_of_a_version(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"u{i}", "t", "alpha beta") for i in range(3)], DOCS)
    root = str(tmp_path / "index")
    I.build(docs).save(root, tombstones=spark.createDataFrame([(1,)], "doc_id long"), ranks=spark.createDataFrame([(0, 0.1), (2, 0.9)], "doc_id long, rank double"))
    hits = Engine(I.Index.load(spark, root)).search(spark.createDataFrame([(0, "alpha")], "query_id long, q string")).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [2, 0]


def test_update_leaves_what_is_unchanged(spark):
    index = I.build(spark.createDataFrame([(0, "a", "A", "one"), (1, "b", "B", "two")], DOCS))
    new, status = I.apply_update(index, spark.createDataFrame([("a", "A", "one"), ("b", "B", "two more")], "url string, title string, text string"), 100)
    assert {(r.url, r.status) for r in status.collect()} == {("a", "unchanged"), ("b", "changed")}
    assert {r.url: r.doc_id >= 100 for r in new.documents.collect()} == {"a": False, "b": True}
