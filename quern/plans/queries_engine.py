"""Queries over the engine's surfaces: whole searches, embeddings, links and ranks, streams as batches, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import cards, html, shortcuts
from quern.functions import text as T
from quern.operators import evaluate, links, semantic, shape, telemetry
from quern.operators import index as I  # noqa: E741
from quern.operators import rank as R
from quern.plans import queries_pages as P
from quern.plans.queries_misc import GAIN, IDEAL, JUDGED, judged, rank_sql
from quern.plans.queries_search import AS_OF, BENCH_TERMS, BM25, QT, SPAN, STOP, TERMS, TOP10, benchmark_terms, simple_index
from quern.plans.registry import DOCS, ORACLES, corpus, literal, query, table, tok, values, words_sql
from quern.plans.search import Engine, Options
from quern.session import shared_dir
from quern.sources import feeds, records, sinks
from quern.streaming import ingest


@query(f"""WITH {QT}, {BM25}, {SPAN}, ix AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df CROSS JOIN stats),
bonus AS (SELECT s.doc_id, 2.0 * sum(idf) / (1 + min(span)) AS bonus FROM spans s JOIN (SELECT DISTINCT doc_id, term FROM placed JOIN qt USING (term)) USING (doc_id) JOIN ix USING (term) WHERE present >= 2 GROUP BY s.doc_id),
f AS (SELECT doc_id, url, title, published, (score + coalesce(bonus, 0)) * (1 + 0.10 * exp(-greatest(({AS_OF} - published) / 86400.0, 0) / 365.0)) AS score FROM bm LEFT JOIN bonus USING (doc_id) JOIN docs USING (doc_id))
SELECT rank::BIGINT AS rank, doc_id, url, title, published, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 3""")
def engine_search(spark, sf_dir):
    """The engine's first three hits: fielded scores, proximity, freshness, canonical urls, stored fields."""
    hits = Engine(simple_index(spark, sf_dir)).search(literal(spark, [(0, " ".join(TERMS))], "query_id long, q string"), Options(k=3, as_of=AS_OF))
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc_id", "url", "title", "published", F.round("score", 6).alias("score"))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, title, {words_sql("text")} AS ws FROM docs), n AS (SELECT *, least(6, ceil(len(ws) / 150.0))::INT AS n FROM w),
p AS (SELECT doc_id, i, title || '. ' || array_to_string(ws[i * 150 + 1 : i * 150 + 150], ' ') AS prompt FROM (SELECT *, unnest(range(n)) AS i FROM n)),
t AS (SELECT doc_id, i, unnest({tok("prompt")}) AS term FROM p), c AS (SELECT doc_id, i, term, count(*) AS n FROM t WHERE term NOT IN ({STOP}) GROUP BY ALL),
h AS (SELECT term, list_reduce([14695981039346656037::HUGEINT] || [('0x' || b)::HUGEINT for b in regexp_extract_all(hex(encode(term)), '..')], lambda a, x: (xor(a, x) * 1099511628211) & 18446744073709551615) AS h FROM (SELECT DISTINCT term FROM c)),
v AS (SELECT doc_id, i, (h % 256)::BIGINT AS place, sum(CASE WHEN h >= 9223372036854775808 THEN -n ELSE n END)::DOUBLE AS v FROM c JOIN h USING (term) GROUP BY ALL),
l AS (SELECT doc_id, i, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL)
SELECT doc_id, i::BIGINT AS passage_idx, place, round((v / norm)::FLOAT::DOUBLE, 6) AS value FROM v JOIN l USING (doc_id, i) WHERE v <> 0""")
def hash_embedding(spark, sf_dir):
    """The built-in embedder over the passages of all documents: every component that isn't 0."""
    v = semantic.embedded(semantic.passages(corpus(spark, sf_dir)), semantic.hash_embedder(stemmed=False))
    parts = v.select("doc_id", F.col("passage_idx").cast("long").alias("passage_idx"), F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return parts.select("doc_id", "passage_idx", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT vec_id, round(list_sum([x / n for x in e]), 6) AS total, round(list_sum([x * x / n / n for x in e]), 6) AS square FROM (SELECT vec_id, [x::DOUBLE for x in embedding] AS e, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS n FROM embeddings)")
def normalized_vectors(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", semantic.normalized(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    add = lambda f: F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + f(x)), 6)
    return unit.select("vec_id", add(lambda x: x).alias("total"), add(lambda x: x * x).alias("square"))


@query(f"WITH {DOCS} SELECT doc_id, sha256(title || chr(0) || text || chr(0) || published) AS hash FROM docs")
def content_hashes(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.content_hash(F.col("title"), F.col("text"), F.col("published")).alias("hash"))


@query("SELECT doc_id, 'https://' || source || '.example.com/' || lang AS url FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1")
def index_last_of_url(spark, sf_dir):
    """Documents that share an url: the last one is indexed."""
    docs = corpus(spark, sf_dir).withColumn("url", F.regexp_replace("url", "/[0-9]+$", ""))
    return I.build(docs).documents.select("doc_id", "url")


@query("SELECT doc_id, 'https://' || source || '.example.com/' || lang AS url FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def ingest_first_of_url(spark, sf_dir):
    """Records of one batch that share an url: the first one counts."""
    docs = corpus(spark, sf_dir).select("doc_id", F.regexp_replace("url", "/[0-9]+$", "").alias("url"))
    return ingest.first_by_url(docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"))


@query("SELECT doc_id, round(2.0 * (1 + 0.5 * ((doc_id % 10) / 10.0) / (SELECT max((doc_id % 10) / 10.0) FROM documents)), 9) AS score FROM documents")
def authority_boost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 / 10.0).alias("rank"))
    most = docs.agg(F.max("rank").alias("most"))
    return docs.crossJoin(F.broadcast(most)).select("doc_id", F.round(R.authority(F.lit(2.0), F.col("rank"), F.col("most")), 9).alias("score"))  # most is one row


def _id(url: str):
    return F.conv(F.substring(F.md5(F.col(url).cast("binary")), 1, 15), 16, 10).cast("long")


LINKED = f"""hl AS ({ORACLES["html_links"]}), src AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url), el AS (SELECT s.url AS a, l.link AS b FROM src s JOIN hl l USING (page_id)),
un AS (SELECT DISTINCT ('0x' || substr(md5(u), 1, 15))::BIGINT AS id FROM (SELECT url AS u FROM src UNION ALL SELECT b FROM el)), e AS (SELECT ('0x' || substr(md5(a), 1, 15))::BIGINT AS src, ('0x' || substr(md5(b), 1, 15))::BIGINT AS dst FROM el WHERE a <> b)"""


def linked_pages(spark, sf_dir):
    """doc_id, url, links of the first page of each url, and of the pages that these link to."""
    first = P.pages(spark, sf_dir).groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    found = first.select("url", html.links(F.col("url"), F.col("html")).alias("links"))
    targets = found.select(F.explode("links").alias("url")).distinct().join(found.select("url"), "url", "left_anti").withColumn("links", F.array().cast("array<string>"))
    return found.unionByName(targets).select(_id("url").alias("doc_id"), "url", "links")


@query(f"WITH {LINKED} SELECT src, dst FROM e")
def link_edges(spark, sf_dir):
    return links.link_graph(linked_pages(spark, sf_dir))


@query(rank_sql(LINKED, links.ROUNDS, "un"))
def link_rank(spark, sf_dir):
    """Ranks of the graph between stored pages, over all rounds."""
    docs = linked_pages(spark, sf_dir)
    return links.pagerank(docs.select("doc_id"), links.link_graph(docs)).select("doc_id", F.round("rank", 9).alias("rank"))


@query("WITH r AS (SELECT doc_id % 10 / 10.0 AS rank FROM documents) SELECT count(*) AS cards, round(min(most), 6) AS least, round(max(most), 6) AS greatest FROM (SELECT unnest(range(34)), (SELECT max(rank) FROM r) AS most)")
def launch_cards_pinned(spark, sf_dir):
    """The sites' own pages take the greatest rank of all documents."""
    docs = corpus(spark, sf_dir).withColumn("rank", F.col("doc_id") % 10 / 10.0)
    with_cards = shortcuts.with_launch_cards(docs, 1 << 40)
    return with_cards.where(F.col("doc_id") >= 1 << 40).agg(F.count("*").alias("cards"), F.round(F.min("rank"), 6).alias("least"), F.round(F.max("rank"), 6).alias("greatest"))


@query(f"WITH {BENCH_TERMS}, {BM25}, r AS ({TOP10}) SELECT query_id, 11 - rank AS rank, doc_id FROM r WHERE query_id IN (SELECT query_id FROM r GROUP BY 1 HAVING count(*) = 10)")
def rerank_reversed(spark, sf_dir):
    """A caller's order over the ten first hits of every benchmark query that has as many: the reverse."""
    ix = simple_index(spark, sf_dir)
    top = R.top(R.lexical(ix, R.matches(ix, benchmark_terms(spark, sf_dir), positions=False)), 10, [F.desc(F.round("score", 9)), F.asc("doc_id")])
    full = top.join(top.groupBy("query_id").agg(F.count("*").alias("n")).where("n = 10"), "query_id")
    hits = full.select("query_id", F.lit("q").alias("q"), "rank", "doc_id", F.lit("t").alias("title"), F.lit("s").alias("snippet"))
    out = shape.rerank(hits, lambda q, items: " ".join(str(i) for i in range(len(items), 0, -1)))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


def views(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = F.concat(F.when(F.col("user_id") % 5 == 0, "!gh ").otherwise(""), F.lit("Query  a "), (F.col("user_id") % 40).cast("string"))
    return e.select(F.col("ts").cast("timestamp").alias("ts"), q.alias("q"), (F.col("event_id") % 7).cast("int").alias("results"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"), "event_id")


@query("SELECT 'query ' || (user_id % 40) AS query, count(*) AS count, epoch_us(max(ts)) AS last_us FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
def session_memory(spark, sf_dir):
    """The stream's plan over all events at once: words of one letter and shortcuts are not remembered."""
    return ingest.session_memory(views(spark, sf_dir)).select("query", "count", F.unix_micros("last_seen").alias("last_us"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS searches, count(*) FILTER (event_id % 7 = 0) AS zero, round(avg(floor(value * 100)::BIGINT), 4) AS avg_ms FROM events GROUP BY 1")
def search_totals(spark, sf_dir):
    return ingest.search_totals(views(spark, sf_dir)).select(F.unix_micros("window.start").alias("start_us"), "searches", "zero", F.round("avg_ms", 4).alias("avg_ms"))


@query("WITH e AS (SELECT ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) > 60000000, true)::INT AS fresh FROM events), b AS (SELECT ts, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT epoch_us(min(ts)) AS start_us, count(*) AS n FROM b GROUP BY burst")
def ingest_bursts(spark, sf_dir):
    return ingest.bursts(views(spark, sf_dir), gap="60 seconds").select(F.unix_micros("session_window.start").alias("start_us"), "n")


@query("WITH g AS (SELECT 'q' || (event_id % 700) AS query, count(*) AS count, max(ts) AS seen FROM events GROUP BY 1) SELECT query, count FROM g ORDER BY count DESC, seen DESC, query LIMIT 512")
def telemetry_kept(spark, sf_dir):
    """Of more queries than the log keeps, the most frequent and recent."""
    log = views(spark, sf_dir).withColumn("query", F.concat(F.lit("q"), (F.col("event_id") % 700).cast("string")))
    return telemetry.per_query(log).select("query", "count")


@query(f"WITH {JUDGED}, {IDEAL}, s AS (SELECT query_id, coalesce(sum({GAIN}) FILTER (rank <= 10), 0) AS dcg, any_value(idcg) AS idcg, max((rank <= 10 AND grade >= 2)::INT) AS success FROM j LEFT JOIN i USING (query_id) GROUP BY query_id) SELECT 'long' AS system, count(*) AS queries, round(avg(dcg), 6) AS dcg, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, round(avg(success), 6) AS success FROM s")
def evaluation_report(spark, sf_dir):
    rep = evaluate.report(evaluate.scores(judged(spark, sf_dir)).withColumn("system", F.lit("long")), ["system"])
    return rep.select("system", "queries", *(F.round(c, 6).alias(c) for c in ("dcg", "ndcg", "success")))


_LOCAL = "html"
for _tag in ("script", "style", "title"):
    _LOCAL = f"regexp_replace({_LOCAL}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace({_LOCAL}, '(?s)<[^>]*>', ' ', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS digest FROM pages")
def html_strip_simple(spark, sf_dir):
    return P.pages(spark, sf_dir).select("page_id", F.md5(html.local_text(F.col("html"))).alias("digest"))


PAGE = '<html><head><title>A &amp; B</title><meta property="article:published_time" content="2024-05-06"></head><body><nav><a href="/n">menu</a></nav><main><h1>Head</h1><p>' + "many words of real content here " * 6 + '</p><a href="../up">up</a><a href="#x">x</a><img src="i.png" alt="pic"></main></body></html>'


@query(f"SELECT * FROM (VALUES ('A & B', 'Head {('many words of real content here ' * 6)}up x', '2024-05-06', 'https://x.org/n,https://x.org/up', 'https://x.org/p/i.png')) t(title, text, published, links, images)")
def html_extract(spark, sf_dir):
    page = html.extract(literal(spark, [("https://x.org/p/q", PAGE)], "url string, html string"))
    return page.select("title", "text", "published", F.array_join("links", ",").alias("links"), F.array_join(F.transform("images", lambda x: x["url"]), ",").alias("images"))


@query("SELECT * FROM (VALUES ('https://x.org/a', 'A', 'one'), ('https://x.org/b', 'B', 'two' || chr(10) || chr(10) || 'three')) t(url, title, text)")
def split_records(spark, sf_dir):
    body = "url: https://x.org/a\ntitle: A\n\none\n---\nno url\n\ndropped\n---\nURL: https://x.org/b\ntitle: B\n\ntwo\n\nthree"
    return records.split_records(literal(spark, [(body,)], "body string")).select("url", "title", "text")


@query("SELECT * FROM (VALUES (0, 'hello'), (1, 'a \\\"b\\\"'), (2, NULL), (3, 'first')) t(i, value)")
def json_string_field(spark, sf_dir):
    bodies = [(0, '{"response": "hello"}'), (1, '{"x": 1, "response" : "a \\"b\\""}'), (2, '{"response": 5}'), (3, '{"n": {"response": "first"}, "response": "second"}')]
    return literal(spark, bodies, "i int, body string").select("i", records.json_field(F.col("body"), "response").alias("value"))


@query("SELECT * FROM (VALUES ('https://a.org/'), ('https://b.org/x')) t(url)")
def seed_file(spark, sf_dir):
    return records.seeds(literal(spark, [("# seeds",), ("https://a.org/  # home",), ("",), ("   ",), ("https://b.org/x",)], "value string"))


@query("SELECT * FROM (VALUES ('https://x.org/a', '2024-01-01'), ('https://x.org/b', '2023-02-03'), ('https://x.org/c', NULL)) t(url, published)")
def publish_hints(spark, sf_dir):
    pages = literal(spark, [("https://x.org/a", "2024-01-01"), ("https://x.org/b", ""), ("https://x.org/c", "")], "url string, published string")
    entries = literal(spark, [("https://x.org/b", "2023-02-03"), ("https://x.org/a", "1999-01-01"), ("https://x.org/b", "2023-03-03")], "url string, published string")
    return feeds.with_hints(pages, entries)


@query("""SELECT * FROM (VALUES (0::BIGINT, '[{"url":"u1","title":"A \\"b\\"","score":"1.50000"},{"url":"u2","title":"B","score":"0.25000","published":86400}]')) t(query_id, json)""")
def json_results(spark, sf_dir):
    rows = [(0, 2, "u2", "B", 0.25, None, [], 86400, None), (0, 1, "u1", 'A "b"', 1.5, None, [], 0, None)]
    return sinks.json_hits(literal(spark, rows, "query_id long, rank int, url string, title string, score double, answer string, images array<struct<url:string,alt:string>>, published long, fresh_label string"))


@query("""SELECT * FROM (VALUES ('["th \\"e",["the","then"]]'), ('["z",[]]')) t(json)""")
def suggestion_json(spark, sf_dir):
    rows = [('th "e', ["the", "then"]), ("z", [])]
    return literal(spark, rows, "q string, items array<string>").select(sinks.suggestion_list(F.col("q"), F.col("items")).alias("json"))


STATIONS = "location: Oslo\ntemp: -3 C\n"
CHAIN = [(0, "weather in oslo", "Weather", "-3 C"), (1, "20% of 80", "Percentage", "16"), (2, "10 km to miles", "Unit conversion", "10 kilometers = 6.213712 miles"), (3, "2 + 2", "Calculator", "4"), (4, "weather in rome", None, None), (5, "rust", None, None)]


@query(f"SELECT * FROM (VALUES {values([(str(i), label, v) for i, _, label, v in CHAIN])}) t(i, label, value)")
def card_precedence(spark, sf_dir):
    """Weather comes first, then percentages, conversions and sums; one card a query."""
    asked = literal(spark, [(i, q) for i, q, _, _ in CHAIN], "query_id long, q string")
    found = cards.card(asked, records.weather(literal(spark, [(STATIONS,)], "value string")))
    return found.select(F.col("query_id").cast("string").alias("i"), "card.label", "card.value")


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, true), (4, false)) t(i, is_definition)")
def definition_intent(spark, sf_dir):
    asked = [(0, "define entropy"), (1, "What is rust"), (2, "what is"), (3, "  definition of x"), (4, "rust")]
    return literal(spark, asked, "i int, q string").select("i", cards.is_definition(F.col("q")).alias("is_definition"))


@query("SELECT * FROM (VALUES (0, 'a b&c'), (1, 'é'), (2, 'x'), (3, NULL)) t(i, value)")
def percent_decode(spark, sf_dir):
    coded = [(0, "a+b%26c"), (1, "%C3%A9"), (2, "x"), (3, "%zz")]
    return literal(spark, coded, "i int, q string").select("i", T.percent_decode(F.col("q")).alias("value"))


ANSWERED = [(0, 1, 10, "T1", "u1"), (0, 2, 11, "T2", "u2"), (1, 1, 11, "T2", "u2")]


def _context(spark):
    hits = literal(spark, ANSWERED, "query_id long, rank int, doc_id long, title string, url string")
    pooled = literal(spark, [(0, 10, 0.9, 1), (0, 11, 0.5, 0), (1, 11, 0.55, 0)], "query_id long, doc_id long, score double, passage_idx int")
    passages = literal(spark, [(10, 0, "zero"), (10, 1, "one &amp; two three"), (11, 0, "other words")], "doc_id long, passage_idx int, text string")
    return hits, pooled, passages


@query("SELECT * FROM (VALUES (0::BIGINT, 1, 'one &amp; two three'), (0, 2, 'other words'), (1, 1, 'other words')) t(query_id, rank, passage)")
def answer_context(spark, sf_dir):
    return shape.answer_context(*_context(spark)).select("query_id", "rank", "passage")


@query("SELECT * FROM (VALUES (0::BIGINT, 'one & two three')) t(query_id, answer)")
def extractive_answer(spark, sf_dir):
    """The best passage of the first hit, where it is near enough."""
    return shape.answers(*_context(spark), semantic.ANSWER_FLOOR)


_LEAD = "Answer from the numbered sources and cite them.' || chr(10) || chr(10) || '"


@query(f"SELECT * FROM (VALUES (0::BIGINT, '{_LEAD}[1] T1 (u1)' || chr(10) || 'one &amp;' || chr(10) || chr(10) || '[2] T2 (u2)' || chr(10) || 'other words' || chr(10) || chr(10) || 'Question: why?' || chr(10) || 'Answer:'), (1, '{_LEAD}[1] T2 (u2)' || chr(10) || 'other words' || chr(10) || chr(10) || 'Question: how?' || chr(10) || 'Answer:')) t(query_id, prompt)")
def answer_prompts(spark, sf_dir):
    asked = literal(spark, [(0, "why?"), (1, "how?")], "query_id long, q string")
    return shape.prompts(shape.answer_context(*_context(spark)), asked, words=2)


@query("SELECT * FROM (VALUES (0::BIGINT, 'Question: why?'), (1, 'Question: how?')) t(query_id, answer)")
def generated_answers(spark, sf_dir):
    """A caller's model over the prompts; this one repeats the question."""
    asked = literal(spark, [(0, "why?"), (1, "how?")], "query_id long, q string")
    return shape.generate(shape.prompts(shape.answer_context(*_context(spark)), asked), lambda p: p.splitlines()[-2])


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


LIVE = "doc_id % 9 <> 0"
LIVE_TOP = f"WITH {QT}, {BM25} SELECT doc_id, round(score, 6) AS score FROM bm".replace("FROM documents)", f"FROM documents WHERE {LIVE})")


def _live_scores(ix):
    scored = R.lexical(ix, R.matches(ix, literal(ix.documents.sparkSession, [(0, t) for t in TERMS], "query_id long, term string"), positions=False))
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query(LIVE_TOP)
def tombstoned_scores(spark, sf_dir):
    """Scores of what is left when every ninth document has a tombstone; statistics count live documents."""
    ix = simple_index(spark, sf_dir)
    return _live_scores(I.without(ix, ix.documents.where(f"not ({LIVE})")))


@query(LIVE_TOP)
def compacted_scores(spark, sf_dir):
    """The same after compaction, from the version that was written."""
    ix = simple_index(spark, sf_dir)
    return _live_scores(I.compact(ix, ix.documents.where(f"not ({LIVE})"), _folder(spark, "compacted")))


@query(f"WITH {BM25.split('scored AS')[0].rstrip().rstrip(',')} SELECT term, df FROM df".replace("WITH ,", "WITH "))
def index_reloaded(spark, sf_dir):
    """Document frequencies of an index that was saved and loaded."""
    return simple_index(spark, sf_dir).stored().doc_frequency()


@query("SELECT 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url, md5(text) AS digest, ((18262 + doc_id * 37 % 2000) * 86400)::BIGINT AS published FROM documents")
def record_round_trip(spark, sf_dir):
    """All documents written as record texts and parsed again."""
    docs = corpus(spark, sf_dir).withColumns({"links": F.array().cast("array<string>"), "images": F.array().cast("array<struct<url:string,alt:string>>")})
    back = records.parse_records(docs.select(sinks.record_text().alias("value")))
    return back.select("url", F.md5("text").alias("digest"), "published")


@query("SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 5 = 2 OR (doc_id % 7 = 0 AND doc_id % 5 <> 1) THEN 'new' ELSE 'old' END AS part FROM documents WHERE doc_id % 5 <> 1")
def update_applied(spark, sf_dir):
    """An index brought up to date: what is unchanged keeps its id, the rest of the store has new ones."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")
    old = I.build(d.where("doc_id % 5 <> 2").select("doc_id", url, F.lit("t").alias("title"), "text"), unique=True)
    store = d.where("doc_id % 5 <> 1").select(url, F.lit("t").alias("title"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    new, _ = I.apply_update(old, store, 1 << 40)
    kept = old.documents.select("doc_id", F.lit("old").alias("part"))
    return new.documents.join(kept, "doc_id", "left").select("url", F.coalesce("part", F.lit("new")).alias("part"))


def _ingested(spark, sf_dir):
    """Two batches of records: every second document, then all, under urls that pairs of documents share."""
    root = _folder(spark, "ingested")
    docs = corpus(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), F.floor(F.col("doc_id") / 2).cast("string"))).drop("doc_id")
    counts = [ingest.ingest_batch(spark, root, part, i) for i, part in enumerate((docs.where(F.crc32("url") % 2 == 0), docs))]
    return root, counts


@query("SELECT 1 AS batch, count(*) AS received, count(DISTINCT doc_id // 2) AS urls FROM documents")
def ingest_counts(spark, sf_dir):
    """What the second batch received, and the urls that both have added together."""
    _, counts = _ingested(spark, sf_dir)
    return literal(spark, [(1, counts[1]["received"], counts[0]["added"] + counts[1]["added"])], "batch int, received long, urls long")


@query("SELECT count(DISTINCT doc_id // 2) AS size, 2 AS segments FROM documents")
def segment_totals(spark, sf_dir):
    root, _ = _ingested(spark, sf_dir)
    return ingest.segments(spark, root).agg(F.sum("size").alias("size"), F.count("*").cast("int").alias("segments"))


SMALL = [(0, "https://a.org", "Rust ownership and borrowing", "rust ownership"), (1, "https://b.org", "Search engine ranking", "search engine")]


def _small(spark):
    return Engine(I.build(literal(spark, SMALL, "doc_id long, url string, title string, text string"), True))


@query("SELECT * FROM (VALUES (0::BIGINT, 'rust ownership'), (1, 'search engine')) t(query_id, corrected)")
def did_you_mean(spark, sf_dir):
    """Corrections that find something."""
    asked = literal(spark, [(0, "rust ownrship"), (1, "serch engne"), (2, "rust ownership"), (3, "zzzzzzzz")], "query_id long, q string")
    return _small(spark).did_you_mean(asked)


@query("SELECT * FROM (VALUES (1, 2::BIGINT, 'Published'), (2, 1, 'Published'), (3, 3, 'Release')) t(rank, doc_id, fresh_label)")
def fresh_vertical_order(spark, sf_dir):
    """The fresh vertical shows dated and fresh pages only, the newest of equal ones first."""
    docs = [(0, "https://x.org/a", "Alpha plain", "alpha", 0), (1, "https://x.org/b", "Alpha b", "alpha", 1700000000), (2, "https://x.org/c", "Alpha c", "alpha", 1760000000), (3, "https://x.org/changelog", "Alpha changelog", "alpha", 0)]
    engine = Engine(I.build(literal(spark, docs, "doc_id long, url string, title string, text string, published long")))
    hits = engine.search(literal(spark, [(0, "alpha")], "query_id long, q string"), Options(vertical="fresh", as_of=AS_OF))
    return hits.select("rank", "doc_id", "fresh_label")


@query("SELECT * FROM (VALUES (1, 1::BIGINT), (2, 0)) t(rank, doc_id)")
def ranked_search(spark, sf_dir):
    """Of equal matches the page with the greater rank comes first."""
    docs = [(0, "u0", "t", "alpha beta", 0.1), (1, "u1", "t", "alpha beta", 0.9)]
    engine = Engine(I.build(literal(spark, docs, "doc_id long, url string, title string, text string, rank double")))
    return engine.search(literal(spark, [(0, "alpha")], "query_id long, q string")).select("rank", "doc_id")
