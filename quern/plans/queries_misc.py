"""Queries over links, vectors, logs, judgements, cards and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import cards, shortcuts
from quern.functions import text as T
from quern.operators import evaluate, links, semantic, shape, telemetry
from quern.operators import index as I  # noqa: E741
from quern.operators import rank as R
from quern.plans.registry import corpus, literal, query, table, values
from quern.sources import records

RANK_EDGES = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"


def rank_sql(edges: str, rounds: int, nodes: str = "(SELECT n_nationkey AS id FROM nation)") -> str:
    return f"""WITH {edges}, w AS (SELECT src, dst, count(*) / any_value(o) AS w FROM e JOIN (SELECT src, count(*)::DOUBLE AS o FROM e GROUP BY src) USING (src) GROUP BY src, dst),
n AS (SELECT id, id IN (SELECT src FROM e) AS linked FROM {nodes}), r0 AS (SELECT id, linked, 1.0 / (SELECT count(*) FROM n) AS r FROM n),
""" + ",\n".join(f"r{i} AS MATERIALIZED (SELECT id, linked, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce((SELECT sum(p.r * w.w) FROM r{i - 1} p JOIN w ON p.id = w.src WHERE w.dst = x.id), 0) + coalesce((SELECT sum(r) FROM r{i - 1} WHERE NOT linked), 0) / (SELECT count(*) FROM n)) AS r FROM r{i - 1} x)" for i in range(1, rounds + 1)) + f"\nSELECT id::BIGINT AS doc_id, round(r, 9) AS rank FROM r{rounds}"


@query(rank_sql(RANK_EDGES, links.ROUNDS))
def pagerank_nations(spark, sf_dir):
    """Trade between nations, over all orders."""
    t = lambda n: table(spark, sf_dir, n)
    trade = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = trade.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))
    return links.pagerank(nodes, edges).select("doc_id", F.round("rank", 9).alias("rank"))


VEC = "v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("passage_idx"), "embedding")


def queries_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(f"WITH {VEC}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_dot_product(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id % 20 = 0) SELECT query_id, doc_id, round(sim, 6) AS sim, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    top = semantic.nearest(queries_of(spark, sf_dir), v, 10)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC}, s AS (SELECT q.vec_id AS query_id, v.label::BIGINT AS doc_id, v.vec_id AS passage_idx, list_dot_product(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id % 20 = 0) SELECT query_id, doc_id, round(max(sim), 6) AS sim, first(passage_idx ORDER BY sim DESC, passage_idx DESC) AS passage_idx FROM s GROUP BY ALL HAVING max(sim) > 0")
def maxpool_topk(spark, sf_dir):
    """The best passage of each document, and which one it is, for documents with a positive one."""
    m = semantic.pooled(queries_of(spark, sf_dir), vectors(spark, sf_dir))
    return m.select("query_id", "doc_id", F.round("score", 6).alias("sim"), "passage_idx")


GRAPH_RANK = "((vec_id * 37) % 101) / 101.0"


@query(f"""WITH {VEC}, n AS (SELECT vec_id, e FROM v ORDER BY {GRAPH_RANK} DESC, vec_id LIMIT 1500), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM p WHERE sim >= 0.5)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(sim), 6) AS sim FROM k WHERE rn <= 4 GROUP BY 1, 2""")
def graph_edges(spark, sf_dir):
    """The feature's greatest graph: 1500 nodes of highest rank, links from 0.5 on."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.expr(GRAPH_RANK).alias("rank"))
    return semantic.similarity_graph(v, 1500).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def ann_lsh_recall(spark, sf_dir):
    """query_id, found, wanted: how many of the exact ten nearest the hashed search has."""
    exact = cosine_topk(spark, sf_dir).select("query_id", "doc_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("passage_idx"), "embedding")
    near = semantic.approximate(queries_of(spark, sf_dir), v, 64, 10, tables=48, bits=5).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))


#: Home, name and text of each site's card.
LAUNCH = [
    ('https://www.youtube.com', 'YouTube', 'YouTube — video lectures, talks, and tutorials. Quick-launch shortcut: !yt (yt youtube).'),
    ('https://github.com', 'GitHub', 'GitHub — source code, repositories, and projects. Quick-launch shortcut: !gh (gh github).'),
    ('https://www.overleaf.com', 'Overleaf', 'Overleaf — collaborative LaTeX papers and templates. Quick-launch shortcut: !ol (ol overleaf).'),
    ('https://stackoverflow.com', 'Stack Overflow', 'Stack Overflow — programming questions and answers. Quick-launch shortcut: !so (so stackoverflow).'),
    ('https://en.wikipedia.org', 'Wikipedia', 'Wikipedia — the free encyclopedia. Quick-launch shortcut: !w (w wiki wikipedia).'),
    ('https://arxiv.org', 'arXiv', 'arXiv — open-access e-prints in physics, math, and CS. Quick-launch shortcut: !ax (ax arxiv).'),
    ('https://scholar.google.com', 'Google Scholar', 'Google Scholar — scholarly papers and citations. Quick-launch shortcut: !sc (sc scholar).'),
    ('https://www.wolframalpha.com', 'Wolfram Alpha', 'Wolfram Alpha — computational answers and math. Quick-launch shortcut: !wa (wa wolfram).'),
    ('https://developer.mozilla.org', 'MDN Web Docs', 'MDN Web Docs — web platform and JavaScript reference. Quick-launch shortcut: !mdn (mdn).'),
    ('https://www.linkedin.com', 'LinkedIn', 'LinkedIn — professional network, jobs, and people. Quick-launch shortcut: !li (li linkedin).'),
    ('https://medium.com', 'Medium', 'Medium — articles, essays, and technical blogs. Quick-launch shortcut: !md (md medium).'),
    ('https://www.kaggle.com', 'Kaggle', 'Kaggle — datasets, notebooks, and ML competitions. Quick-launch shortcut: !kg (kg kaggle).'),
    ('https://www.reddit.com', 'Reddit', 'Reddit — communities and discussion threads. Quick-launch shortcut: !r (r reddit).'),
    ('https://news.ycombinator.com', 'Hacker News', 'Hacker News — startup and technology news. Quick-launch shortcut: !hn (hn hackernews).'),
    ('https://dev.to', 'DEV Community', 'DEV Community — developer articles and discussion. Quick-launch shortcut: !dev (dev devto).'),
    ('https://huggingface.co', 'Hugging Face', 'Hugging Face — models, datasets, and ML spaces. Quick-launch shortcut: !hf (hf huggingface).'),
    ('https://chatgpt.com', 'ChatGPT', "ChatGPT — OpenAI's chat assistant. Quick-launch shortcut: !gpt (gpt chatgpt)."),
    ('https://claude.ai', 'Claude', "Claude — Anthropic's AI assistant. Quick-launch shortcut: !cl (cl claude)."),
    ('https://www.npmjs.com', 'npm', 'npm — JavaScript package registry. Quick-launch shortcut: !npm (npm).'),
    ('https://crates.io', 'crates.io', 'crates.io — the Rust package registry. Quick-launch shortcut: !cr (cr crates).'),
    ('https://pypi.org', 'PyPI', 'PyPI — the Python package index. Quick-launch shortcut: !pypi (pypi).'),
    ('https://www.google.com', 'Google', 'Google — the web search engine. Quick-launch shortcut: !g (g google).'),
    ('https://duckduckgo.com', 'DuckDuckGo', 'DuckDuckGo — privacy-first web search. Quick-launch shortcut: !ddg (ddg).'),
    ('https://mail.google.com', 'Gmail', 'Gmail — your email. Quick-launch shortcut: !gm (gm gmail).'),
    ('https://maps.google.com', 'Google Maps', 'Google Maps — maps, directions, and places. Quick-launch shortcut: !maps (maps gmaps).'),
    ('https://drive.google.com', 'Google Drive', 'Google Drive — your files and documents. Quick-launch shortcut: !drive (drive gdrive).'),
    ('https://x.com', 'X (Twitter)', 'X (Twitter) — posts and real-time updates. Quick-launch shortcut: !x (x twitter).'),
    ('https://www.amazon.com', 'Amazon', 'Amazon — online shopping. Quick-launch shortcut: !az (az amazon).'),
    ('https://www.netflix.com', 'Netflix', 'Netflix — films and series. Quick-launch shortcut: !nf (nf netflix).'),
    ('https://open.spotify.com', 'Spotify', 'Spotify — music and podcasts. Quick-launch shortcut: !sp (sp spotify).'),
    ('https://www.imdb.com', 'IMDb', 'IMDb — films, TV, and cast. Quick-launch shortcut: !imdb (imdb).'),
    ('https://www.twitch.tv', 'Twitch', 'Twitch — live streams and gaming. Quick-launch shortcut: !tw (tw twitch).'),
    ('https://www.notion.so', 'Notion', 'Notion — notes, docs, and wikis. Quick-launch shortcut: !nt (nt notion).'),
    ('https://www.figma.com', 'Figma', 'Figma — collaborative design. Quick-launch shortcut: !fig (fig figma).'),
]
BANGS = [(0, "!gh rust async"), (1, "!yt"), (2, "!nope something"), (3, "!so how to do x?"), (4, "cats !w big")]


@query("SELECT * FROM (VALUES (0::BIGINT, 'https://github.com/search?q=rust%20async&type=repositories'), (1, 'https://www.youtube.com'), (3, 'https://stackoverflow.com/search?q=how%20to%20do%20x%3F'), (4, 'https://en.wikipedia.org/w/index.php?search=cats%20big')) t(query_id, url)")
def bang_resolve(spark, sf_dir):
    return shortcuts.resolve(literal(spark, BANGS, "query_id long, q string"))


@query(f"SELECT url, title, text FROM (VALUES {', '.join('(' + values([(home, name, text)])[1:] for home, name, text in LAUNCH)}) t(url, title, text)")
def launch_cards(spark, sf_dir):
    return shortcuts.launch_cards(spark)


CARDS = [("2 + 2", "4"), ("2 * (5 + 3)", "16"), ("2^8", "256"), ("2^3^2", "512"), ("-2^2", "4"), ("sqrt(16)", "4"), ("1 / 0", None), ("2024-01-01", "2022"), ("20% of 80", "16"), ("what is 12.5 percent of 240", "30"), ("20 is what percent of 80", "25%"), ("what percentage is 3 of 12", "25%"), ("10 km to miles", "10 kilometers = 6.213712 miles"), ("5 kg in lb", "5 kilograms = 11.023113 pounds"), ("32 f to c", "32 F = 0 C"), ("10 kg to miles", None), ("1 m to ft", "1 meter = 3.28084 feet"), ("hello world", None)]


@query(f"SELECT * FROM (VALUES {values(CARDS)}) t(q, value)")
def local_cards(spark, sf_dir):
    return literal(spark, [(q,) for q, _ in CARDS], "q string").select("q", cards.local_card(F.col("q"))["value"].alias("value"))


WEATHER = "# stations\nlocation: Sydney Harbour\naliases: Sydney, SYD\ntemp: 21 C\ncondition: Sunny\nwind: 10 km/h\n\nplace: Oslo\ntemperature: -3 C\n\nlocation: Nowhere\n"
ASKED = [(0, "weather in sydney"), (1, "weather oslo?"), (2, "weather"), (3, "weather in paris"), (4, "rust")]


@query("SELECT * FROM (VALUES (0::BIGINT, 'Sydney Harbour', '21 C', 'Sunny · Wind 10 km/h'), (1, 'Oslo', '-3 C', NULL)) t(query_id, title, value, detail)")
def weather_cards(spark, sf_dir):
    found = cards.weather_cards(literal(spark, ASKED, "query_id long, q string"), records.weather(literal(spark, [(WEATHER,)], "value string")))
    return found.select("query_id", "card.title", "card.value", "card.detail")


SNAP = "store AS (SELECT 'u' || doc_id AS url, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 1), idx AS (SELECT 'u' || doc_id AS url, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 2)"


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.where("doc_id % 5 <> 1").select(url, F.sha2(text, 256).alias("hash")), d.where("doc_id % 5 <> 2").select(url, F.sha2("text", 256).alias("hash"))


@query(f"WITH {SNAP} SELECT coalesce(s.url, i.url) AS url, CASE WHEN i.url IS NULL THEN 'added' WHEN s.url IS NULL THEN 'deleted' WHEN s.hash = i.hash THEN 'unchanged' ELSE 'changed' END AS status FROM store s FULL JOIN idx i ON s.url = i.url")
def update_diff(spark, sf_dir):
    return I.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT url FROM store WHERE url NOT IN (SELECT url FROM idx)")
def ingest_skip_existing(spark, sf_dir):
    return I.skip_existing(*_snapshots(spark, sf_dir)).select("url")


@query("SELECT count(*) FILTER (doc_id % 9 <> 0) AS live, count(*) AS total, count(*) FILTER (doc_id % 9 = 0) AS tombstones, count(*) FILTER (doc_id % 9 <> 0 AND (18262 + doc_id * 37 % 2000) > 0) AS dated FROM documents")
def tombstone_stats(spark, sf_dir):
    docs = I.build(corpus(spark, sf_dir)).documents
    return I.summary(docs, docs.where("doc_id % 9 = 0")).select("live", "total", "tombstones", "dated")


SIZES = "sizes AS (SELECT source AS segment_id, count(*) * (1 + length(source)) AS size FROM documents GROUP BY source)"


@query(f"WITH {SIZES}, l AS (SELECT segment_id, size, CASE WHEN size <= 1 THEN 0 ELSE floor(ln(size) / ln(10.0)) END::BIGINT AS level FROM sizes WHERE size > 0 AND size < 500000) SELECT segment_id, size::BIGINT AS size, level FROM l")
def merge_policy_levels(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("segment_id")).agg((F.count("*") * (1 + F.length(F.first("source")))).alias("size"))
    return I.merge_levels(s).select("segment_id", "size", F.col("level").cast("long").alias("level"))


@query(f"WITH {SIZES}, l AS (SELECT segment_id, size, CASE WHEN size <= 1 THEN 0 ELSE floor(ln(size) / ln(10.0)) END AS level FROM sizes), m AS (SELECT min(level) AS level FROM (SELECT level FROM l GROUP BY level HAVING count(*) >= 10)), r AS (SELECT l.*, row_number() OVER (ORDER BY size, segment_id) AS rn FROM l JOIN m USING (level)) SELECT segment_id, size::BIGINT AS size FROM r WHERE rn <= 10")
def merge_policy_pick(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("segment_id")).agg((F.count("*") * (1 + F.length(F.first("source")))).alias("size"))
    return I.merge_pick(s).select("segment_id", "size")


def search_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return telemetry.searches(e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("Query  "), (F.col("user_id") % 40).cast("string")).alias("query"), (F.col("event_id") % 7).cast("int").alias("results"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms")))


def click_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    url = F.concat(F.when(F.col("event_id") % 11 == 0, "ftp").otherwise("https"), F.lit("://x.org/"), (F.col("event_id") % 30).cast("string"))
    return telemetry.clicks(e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("Query  "), (F.col("user_id") % 40).cast("string")).alias("query"), url.alias("url")))


S_LOG = "s AS (SELECT ts, 'query ' || (user_id % 40) AS query, (event_id % 7)::INT AS results, floor(value * 100)::BIGINT AS ms FROM events WHERE event_type = 'view')"
C_LOG = "c AS (SELECT ts, 'query ' || (user_id % 40) AS query, 'https://x.org/' || (event_id % 30) AS url FROM events WHERE event_type = 'click' AND event_id % 11 <> 0)"


@query(f"WITH {S_LOG}, {C_LOG} SELECT count(*) AS searches, round(avg((results = 0)::INT), 6) AS zero_rate, round(avg(ms), 4) AS avg_ms, (SELECT count(*) FROM c) AS clicks FROM s")
def telemetry_summary(spark, sf_dir):
    return telemetry.totals(search_log(spark, sf_dir), click_log(spark, sf_dir)).select("searches", F.round("zero_rate", 6).alias("zero_rate"), F.round("avg_ms", 4).alias("avg_ms"), "clicks")


@query(f"WITH {S_LOG} SELECT query, count(*) AS count, count(*) FILTER (results = 0) AS zero, round(avg(results), 6) AS avg_results, round(avg(ms), 4) AS avg_ms FROM s GROUP BY query")
def telemetry_queries(spark, sf_dir):
    return telemetry.per_query(search_log(spark, sf_dir)).select("query", "count", "zero", F.round("avg_results", 6).alias("avg_results"), F.round("avg_ms", 4).alias("avg_ms"))


@query(f"WITH {C_LOG}, g AS (SELECT url, count(*) AS clicks, first(query ORDER BY ts DESC, query DESC) AS last_query, max(ts) AS seen FROM c GROUP BY url) SELECT url, clicks, last_query FROM g ORDER BY clicks DESC, seen DESC, url LIMIT 8")
def telemetry_top_clicks(spark, sf_dir):
    return telemetry.per_url(click_log(spark, sf_dir)).orderBy(F.desc("clicks"), F.desc("last_seen"), "url").limit(8).select("url", "clicks", "last_query")


@query(f"WITH {S_LOG}, l AS (SELECT ms FROM s ORDER BY ts DESC, query DESC, ms DESC LIMIT 512), o AS (SELECT list_sort(list(ms)) AS v FROM l) SELECT v[1 + ((len(v) - 1) * 95 // 100)] AS p95 FROM o")
def latency_p95(spark, sf_dir):
    return telemetry.p95(search_log(spark, sf_dir), ["ts", "query", "elapsed_ms"], "elapsed_ms")


@query("WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e), g AS (SELECT user_id, burst, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM b GROUP BY ALL) SELECT user_id, count(*) AS bursts, max(n) AS longest, sum(us)::BIGINT AS total_us FROM g GROUP BY user_id")
def session_lull(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    b = telemetry.lulls(e, 21600, ["user_id"]).withColumn("us", F.unix_micros("stop") - F.unix_micros("start"))
    return b.groupBy("user_id").agg(F.count("*").alias("bursts"), F.max("n").alias("longest"), F.sum("us").alias("total_us"))


JUDGED = "j AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, coalesce(3 * quality - 2 * toxic * quality, 0) AS grade FROM documents JOIN labels USING (doc_id))"
GAIN = "(pow(2, grade) - 1) / log2(rank + 1.0)"
IDEAL = f"b AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rank FROM j), i AS (SELECT query_id, sum({GAIN}) AS idcg FROM b WHERE rank <= 10 GROUP BY 1)"


def judged(spark, sf_dir, order=("n_chars", "doc_id")):
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc(order[0]), order[1])
    return d.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("url"), F.row_number().over(w).alias("rank"), F.coalesce(3 * F.col("quality") - 2 * F.col("toxic") * F.col("quality"), F.lit(0)).alias("grade"))


@query(f"WITH {JUDGED}, {IDEAL} SELECT query_id, round(coalesce(sum({GAIN}) FILTER (rank <= 10), 0), 6) AS dcg, round(CASE WHEN any_value(idcg) > 0 THEN coalesce(sum({GAIN}) FILTER (rank <= 10), 0) / any_value(idcg) ELSE 0 END, 6) AS ndcg FROM j LEFT JOIN i USING (query_id) GROUP BY query_id")
def ndcg_at_10(spark, sf_dir):
    return evaluate.scores(judged(spark, sf_dir)).select("query_id", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {JUDGED} SELECT query_id, max((rank <= 10 AND grade >= 2)::INT)::BIGINT AS success, min(rank) FILTER (grade >= 2)::BIGINT AS first_good FROM j GROUP BY query_id")
def success_at_10(spark, sf_dir):
    return evaluate.scores(judged(spark, sf_dir)).select("query_id", F.col("success").cast("long").alias("success"), F.col("first_good").cast("long").alias("first_good"))


@query(f"""WITH {JUDGED}, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank, grade FROM j),
u AS (SELECT 'long' AS system, * FROM j UNION ALL SELECT 'new', * FROM k), p AS (SELECT query_id, doc_id, max(grade) AS grade FROM u WHERE rank <= 50 GROUP BY ALL),
b AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rank FROM p), i AS (SELECT query_id, sum({GAIN}) AS idcg FROM b WHERE rank <= 10 GROUP BY 1)
SELECT system, query_id, round(CASE WHEN any_value(idcg) > 0 THEN coalesce(sum({GAIN}) FILTER (rank <= 10), 0) / any_value(idcg) ELSE 0 END, 6) AS ndcg FROM u LEFT JOIN i USING (query_id) WHERE rank <= 50 GROUP BY ALL""")
def shared_pool_ndcg(spark, sf_dir):
    a = judged(spark, sf_dir).withColumn("system", F.lit("long"))
    b = judged(spark, sf_dir, ("doc_id", "n_chars")).withColumn("system", F.lit("new"))
    both = a.unionByName(b).where("rank <= 50")
    return evaluate.scores(both, 10, evaluate.shared_pool(both), ["system", "query_id"], ["query_id"]).select("system", "query_id", F.round("ndcg", 6).alias("ndcg"))


GRADES = [(0, 1, "https://doc.rust-lang.org/book/"), (0, 2, "https://x.org/rust"), (0, 3, "https://x.org/other")]


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 3::BIGINT), (0, 2, 2), (0, 3, 0)) t(query_id, rank, grade)")
def url_pattern_grades(spark, sf_dir):
    r = literal(spark, GRADES, "query_id long, rank int, url string")
    q = literal(spark, [(0, "doc.rust-lang.org/book", 3), (0, "rust-lang", 1), (0, "/rust$", 2), (0, "/book$", 2), (1, "other", 3)], "query_id long, url_pattern string, grade int")
    return evaluate.graded(r, q).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("grade").cast("long").alias("grade"))


ORDERS = [("3,1,4,2", 4, "2,0,3,1"), ("I think 2 then 1", 4, "1,0,2,3"), ("9 and 1", 3, "0,1,2"), ("none", 3, "0,1,2")]


@query(f"SELECT * FROM (VALUES {values([(a, c) for a, _, c in ORDERS])}) t(reply, parsed)")
def rerank_reply(spark, sf_dir):
    """The order that each reply puts its hits in; hits are named by their places."""
    asked = literal(spark, [(i, a, n) for i, (a, n, _) in enumerate(ORDERS)], "query_id long, q string, n int")
    hits = asked.select("query_id", "q", F.explode(F.sequence(F.lit(1), "n")).alias("rank")).select("query_id", "q", "rank", (F.col("rank") - 1).cast("string").alias("title"), F.lit("").alias("snippet"))
    done = shape.rerank(hits, lambda q, items: q).groupBy("query_id", F.col("q").alias("reply"))
    return done.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), ",").alias("parsed")).select("reply", "parsed")


@query("SELECT doc_id, md5(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 8000)) AS digest FROM documents")
def stored_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.stored_text(F.col("text"))).alias("digest"))
