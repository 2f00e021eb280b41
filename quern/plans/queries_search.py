"""Queries over the search corpus: analysis, postings, ranking, filters, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls
from quern.operators import index as I  # noqa: E741
from quern.operators import rank as R
from quern.operators import semantic, shape, vocabulary
from quern.plans.queryparse import parsed
from quern.plans.registry import DOCS, corpus, literal, query, table, tok, values, words_sql
from quern.plans.search import Engine, Options

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
PLACED = f"""{DOCS},
tk AS (SELECT doc_id, url, {tok("title")} AS tt, {tok("text")} AS tb FROM docs),
pl AS (SELECT doc_id, true AS title, generate_subscripts(tt, 1) - 1 AS pos, unnest(tt) AS term FROM tk
  UNION ALL SELECT doc_id, false, len(tt) + {I.FIELD_GAP} + generate_subscripts(tb, 1) - 1, unnest(tb) FROM tk),
placed AS (SELECT * FROM pl WHERE term NOT IN ({STOP}))"""
POSTINGS = f"""{PLACED},
postings AS (SELECT term, doc_id, count(*) FILTER (title) AS tf_title, count(*) FILTER (NOT title) AS tf_body FROM placed GROUP BY ALL),
lens AS (SELECT doc_id, count(term) FILTER (placed.title) AS lt, count(term) FILTER (NOT placed.title) AS lb FROM docs LEFT JOIN placed USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n, coalesce(nullif(avg(lt), 0), 1.0) AS at_, coalesce(nullif(avg(lb), 0), 1.0) AS ab FROM lens)"""
BM25 = f"""{POSTINGS},
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT qt.query_id, p.doc_id, p.term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf,
  (CASE WHEN tf_title > 0 THEN 3.0 * tf_title / (0.25 + 0.75 * lt / at_) ELSE 0 END + CASE WHEN tf_body > 0 THEN 1.0 * tf_body / (0.25 + 0.75 * lb / ab) ELSE 0 END) AS w
  FROM qt JOIN postings p USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats),
bm AS (SELECT query_id, doc_id, sum(idf * (w / (1.2 + w))) AS score FROM scored GROUP BY ALL)"""
BENCH_TERMS = f"""qt AS (SELECT DISTINCT item_id AS query_id, unnest(({tok("text")})[1:6]) AS term FROM benchmark)"""
TOP10 = "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10"
TERMS = ["reed", "onst", "erth"]
QT = f"qt AS (SELECT 0::BIGINT AS query_id, unnest({TERMS!r}) AS term)"


def simple_index(spark, sf_dir) -> I.Index:
    return I.build(corpus(spark, sf_dir), unique=True)


def benchmark_terms(spark, sf_dir):
    """The first six tokens of each benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode_outer(F.slice(T.tokenize(F.col("text")), 1, 6)).alias("term")).where("term is not null").distinct()


def top10(scores):
    ranked = R.top(scores, 10, [F.desc(F.round("score", 9)), F.asc("doc_id")])
    return ranked.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def tokenize_df_cf(spark, sf_dir):
    by_doc = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(T.tokenize(F.col("text"))).alias("term")).where("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@query(f"SELECT doc_id, list_sum([1 for t in {tok('text')} if t NOT IN ({STOP})] || [0])::BIGINT AS n_terms, len({tok('text')})::BIGINT AS n_tokens FROM documents")
def stopword_filtered_terms(spark, sf_dir):
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(t, lambda x: ~T.is_stop_word(x))).cast("long").alias("n_terms"), F.size(t).cast("long").alias("n_tokens"))


@query(f"WITH {PLACED} SELECT doc_id, count(*) AS n, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos, sum(pos)::BIGINT AS sum_pos FROM placed GROUP BY doc_id")
def token_positions(spark, sf_dir):
    by_doc = I.places_of(I.analyzed(corpus(spark, sf_dir))).groupBy("doc_id")
    pos = F.col("pos").cast("long")
    return by_doc.agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.sum(pos).alias("sum_pos"))


PORTER = list(zip("caresses ponies cats running happy relational conditional rationalization connection connected agreed plastered".split(), "caress poni cat run happi relat condit ration connect connect agre plaster".split()))


@query(f"SELECT * FROM (VALUES {values(PORTER)}) t(word, stem)")
def porter_known_cases(spark, sf_dir):
    d = literal(spark, [(w,) for w, _ in PORTER], "word string")
    return d.select("word", F.get(T.stem_all(F.array("word")), F.lit(0)).alias("stem"))


@query()
def stem_document_frequency(spark, sf_dir):
    return I.build(corpus(spark, sf_dir), stemmed=True, unique=True).doc_frequency()


@query(f"WITH {POSTINGS} SELECT n::BIGINT AS n, round(at_, 6) AS avg_title, round(ab, 6) AS avg_body FROM stats")
def corpus_field_stats(spark, sf_dir):
    return simple_index(spark, sf_dir).stats().select("n", F.round("avg_title", 6).alias("avg_title"), F.round("avg_body", 6).alias("avg_body"))


@query(f"WITH {POSTINGS} SELECT term, doc_id, tf_title::BIGINT AS tf_title, tf_body::BIGINT AS tf_body FROM postings")
def postings_tf(spark, sf_dir):
    return simple_index(spark, sf_dir).postings.select("term", "doc_id", F.col("tf_title").cast("long").alias("tf_title"), F.col("tf_body").cast("long").alias("tf_body"))


def _scores(spark, sf_dir, terms):
    ix = simple_index(spark, sf_dir)
    return R.lexical(ix, R.matches(ix, terms, positions=False))


def _terms(spark):
    return literal(spark, [(0, t) for t in TERMS], "query_id long, term string")


@query(f"WITH {QT}, {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25f_scores(spark, sf_dir):
    return _scores(spark, sf_dir, _terms(spark)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {QT}, {BM25} {TOP10}")
def bm25f_topk(spark, sf_dir):
    return top10(_scores(spark, sf_dir, _terms(spark)))


@query(f"WITH {BENCH_TERMS}, {BM25} {TOP10}")
def bm25f_multi_query_topk(spark, sf_dir):
    return top10(_scores(spark, sf_dir, benchmark_terms(spark, sf_dir)))


@query(f"WITH {BENCH_TERMS}, {BM25} {TOP10}")
def bm25f_pruned_topk(spark, sf_dir):
    """The same hits from stored impacts, without the frequent words' postings."""
    asked = benchmark_terms(spark, sf_dir)
    ranked = R.pruned_top(simple_index(spark, sf_dir).impacts(asked), asked, 10, [F.desc(F.round("score", 9)), F.asc("doc_id")])
    return ranked.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


#: Two words beside each other, and two with a stop word between them.
PHRASES = [(0, 0, "reed", 0), (0, 0, "ed", 1), (1, 0, "er", 0), (1, 0, "er", 2)]
PHRASE_SQL = f"""WITH {PLACED}, ph(query_id, term, at_) AS (VALUES @rows),
hits AS (SELECT query_id, doc_id, pos - at_ AS base, count(DISTINCT at_) AS n FROM placed JOIN ph USING (term) GROUP BY ALL)
SELECT DISTINCT query_id::BIGINT AS query_id, doc_id FROM hits JOIN (SELECT query_id, count(*) AS need FROM ph GROUP BY 1) USING (query_id) WHERE n = need"""


def _phrase(spark, sf_dir, query_id):
    rows = [r for r in PHRASES if r[0] == query_id]
    return R.phrase_docs(simple_index(spark, sf_dir), literal(spark, rows, "query_id long, phrase int, term string, at int")).select("query_id", "doc_id")


@query(PHRASE_SQL.replace("@rows", values([(q, t, a) for q, _, t, a in PHRASES if q == 0])))
def phrase_match(spark, sf_dir):
    return _phrase(spark, sf_dir, 0)


@query(PHRASE_SQL.replace("@rows", values([(q, t, a) for q, _, t, a in PHRASES if q == 1])))
def phrase_with_stopword_gap(spark, sf_dir):
    return _phrase(spark, sf_dir, 1)


LAST = ", ".join(f"max(CASE WHEN term = '{t}' THEN pos END) OVER w AS l{i}" for i, t in enumerate(TERMS))
HAS = " AND ".join(f"(l{i} IS NOT NULL OR NOT h{i})" for i in range(len(TERMS)))
SPAN = f"""p0 AS (SELECT doc_id, pos, term FROM placed JOIN qt USING (term)),
p1 AS (SELECT *, {", ".join(f"bool_or(term = '{t}') OVER (PARTITION BY doc_id) AS h{i}" for i, t in enumerate(TERMS))}, {LAST} FROM p0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT doc_id, {" + ".join(f"max(h{i}::INT)" for i in range(len(TERMS)))} AS present, min(pos - least({", ".join(f"l{i}" for i in range(len(TERMS)))})) AS span FROM p1 WHERE {HAS} GROUP BY doc_id)"""


def _spans(spark, sf_dir):
    ix = simple_index(spark, sf_dir)
    m = R.matches(ix, _terms(spark))
    return m, R.cover_spans(m.select("query_id", "doc_id", "term", F.explode("positions").alias("pos")))


@query(f"WITH {QT}, {PLACED}, {SPAN} SELECT doc_id, present::BIGINT AS present, span::BIGINT AS span FROM spans")
def min_cover_span(spark, sf_dir):
    _, s = _spans(spark, sf_dir)
    return s.select("doc_id", F.size("present").cast("long").alias("present"), F.col("span").cast("long").alias("span"))


@query(f"""WITH {QT}, {POSTINGS}, {SPAN}, df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df CROSS JOIN stats)
SELECT s.doc_id, round(2.0 * sum(idf) / (1 + min(span)), 6) AS bonus FROM spans s JOIN (SELECT DISTINCT doc_id, term FROM placed JOIN qt USING (term)) USING (doc_id) JOIN i USING (term) WHERE present >= 2 GROUP BY s.doc_id""")
def proximity_bonus(spark, sf_dir):
    m, s = _spans(spark, sf_dir)
    return R.proximity(s, m.select("term", "idf")).select("doc_id", F.round("bonus", 6).alias("bonus"))


def _filtered(spark, sf_dir, text):
    engine = Engine(simple_index(spark, sf_dir))
    q = parsed(literal(spark, [(0, text)], "query_id long, q string"), False)
    every = engine.index.documents.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    return engine._filtered(every, q, engine.index.documents).select("doc_id")


@query(f"WITH {PLACED} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM placed WHERE term = 'reed')")
def filter_exclude_term(spark, sf_dir):
    return _filtered(spark, sf_dir, "-reed")


@query(f"WITH {PLACED} SELECT doc_id FROM placed WHERE title AND term IN ('anea', 'attion') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def filter_intitle(spark, sf_dir):
    return _filtered(spark, sf_dir, "intitle:anea intitle:Attion")


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(lower(url), 'en') AND contains(lower(url), 'src1')")
def filter_inurl(spark, sf_dir):
    return _filtered(spark, sf_dir, "inurl:EN/ inurl:src1")


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE starts_with(regexp_replace(lower(url), '^https://', ''), 'src1.example.com/en') OR starts_with(regexp_replace(lower(url), '^https://', ''), 'src2.example.com')")
def filter_site(spark, sf_dir):
    return _filtered(spark, sf_dir, "site:src1.example.com/en site:https://src2.example.com/")


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE published >= epoch(DATE '2021-01-01')::BIGINT AND published < epoch(DATE '2022-07-01')::BIGINT")
def filter_date_range(spark, sf_dir):
    return _filtered(spark, sf_dir, "after:2021 before:2022-07-01")


@query(f"WITH {DOCS} SELECT 0::BIGINT AS query_id, doc_id, 1.0::DOUBLE AS score FROM docs WHERE starts_with(url, 'https://src3.example.com') AND published >= epoch(DATE '2023-01-01')::BIGINT")
def filter_only_seed(spark, sf_dir):
    q = literal(spark, [(0, "site:src3.example.com after:2023-01-01"), (1, "-reed")], "query_id long, q string")
    engine = Engine(simple_index(spark, sf_dir))
    p = parsed(q, False)
    return engine._filtered(engine.seeds(p, engine.index.documents), p, engine.index.documents)


#: Pages of several kinds: the extension follows from the id.
KINDS = "CASE doc_id % 4 WHEN 0 THEN '.PDF?page=2' WHEN 1 THEN '/notes.txt#top' WHEN 2 THEN '.html' ELSE '' END"


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1)")
def filter_filetype(spark, sf_dir):
    """filetype: on documents whose urls end in .PDF, .txt, .html or nothing."""
    docs = corpus(spark, sf_dir)
    engine = Engine(I.build(docs.withColumn("url", F.concat("url", F.expr(KINDS))), unique=True))
    q = parsed(literal(spark, [(0, "filetype:pdf filetype:.txt")], "query_id long, q string"), False)
    every = engine.index.documents.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    return engine._filtered(every, q, engine.index.documents).select("doc_id")


OPERATORS = ['rust OR ownership site:doc.rust-lang.org -unsafe intitle:book filetype:pdf inurl:guide after:2025 "borrow checker"', "-site:x after:1970 filetype:. plain", '"open quote runs']


@query("SELECT * FROM (VALUES (0::BIGINT, 'rust ownership \"borrow checker\"', 'rust,ownership,borrow,checker', 1::BIGINT, 'unsaf', 'doc.rust-lang.org', 'book', 'pdf', 'guide', 1735689600::BIGINT), (1, '-site:x after:1970 filetype:. plain', 'site,x,after,1970,filetyp,plain', 0, '', '', '', '', '', NULL), (2, '\"open quote runs', 'open,quot,run', 0, '', '', '', '', '', NULL)) t(query_id, clean, terms, n_phrases, excludes, sites, titles, filetypes, inurls, after)")
def query_operators(spark, sf_dir):
    p = parsed(literal(spark, list(enumerate(OPERATORS)), "query_id long, q string"))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return p.select("query_id", "clean", F.array_join("terms", ",").alias("terms"), F.size("phrases").cast("long").alias("n_phrases"), *(listed(c) for c in ("excludes", "sites", "titles", "filetypes", "inurls")), "after")


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {words_sql("text")} AS ws FROM docs),
n AS (SELECT doc_id, ws, least(6, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 150 THEN 1 ELSE ceil((len(ws) - 150) / 130.0) + 1 END)::INT AS n FROM w),
p AS (SELECT doc_id, ws, unnest(range(n)) AS i FROM n)
SELECT doc_id, i::BIGINT AS passage_idx, md5(array_to_string(ws[i * 130 + 1 : i * 130 + 150], ' ')) AS digest FROM p""")
def passage_chunks(spark, sf_dir):
    p = semantic.passages(corpus(spark, sf_dir), 150, 6, 20)
    return p.select("doc_id", F.col("passage_idx").cast("long").alias("passage_idx"), F.md5("text").alias("digest"))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {words_sql("text")} AS ws FROM docs),
f AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word, len(ws) AS n FROM w),
m AS (SELECT *, list_has_any({tok("word")}, {TERMS!r})::INT AS hit FROM f),
c AS (SELECT doc_id, i, n, sum(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS hits FROM m)
SELECT doc_id, first(i ORDER BY hits DESC, i)::BIGINT AS start, max(hits)::BIGINT AS hits FROM c WHERE i <= greatest(n - 32, 0) GROUP BY doc_id""")
def snippet_window(spark, sf_dir):
    d = corpus(spark, sf_dir).where(F.col("text").rlike(r"(?U)\S"))
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    seen = lambda flags, at: F.struct(at.cast("long").alias("start"), F.size(F.filter(F.slice(flags, at + 1, 32), lambda f: f == 1)).cast("long").alias("hits"))
    best = T.let(T.word_flags(words, F.array(*map(F.lit, TERMS))), lambda flags: T.let(T.best_window(flags, 32), lambda at: seen(flags, at)))
    return d.select("doc_id", best.alias("best")).select("doc_id", "best.start", "best.hits")


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {words_sql("text")} AS ws FROM docs),
f AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word, len(ws) AS n FROM w),
m AS (SELECT *, list_has_any({tok("word")}, {TERMS!r})::INT AS hit FROM f),
c AS (SELECT doc_id, i, n, sum(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS hits FROM m),
s AS (SELECT doc_id, first(i ORDER BY hits DESC, i) AS start FROM c WHERE i <= greatest(n - 32, 0) GROUP BY doc_id),
b AS (SELECT doc_id, ws, coalesce(start, 0) AS start FROM w LEFT JOIN s USING (doc_id))
SELECT doc_id, CASE WHEN start > 0 THEN '… ' ELSE '' END || array_to_string([CASE WHEN list_has_any({tok("x")}, {TERMS!r}) THEN '<mark>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</mark>' ELSE replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END for x in ws[start + 1 : start + 32]], ' ') || CASE WHEN start + 32 < len(ws) THEN ' …' ELSE '' END AS snippet FROM b""")
def snippet_marked(spark, sf_dir):
    """The marked best window of every whole text."""
    return corpus(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), F.array(*map(F.lit, TERMS))).alias("snippet"))


MISSPELT = [(0, "thhaen thinng"), (1, "entin reedd"), (2, "zzzzzzzzzz"), (3, "example httpss")]
VOCAB = f"""{DOCS}, tw AS (SELECT unnest({tok("title")}) AS term, 3 AS w FROM docs UNION ALL SELECT unnest({tok("url")}), 1 FROM docs),
vocab AS (SELECT term, sum(w)::BIGINT AS weight FROM tw WHERE strlen(term) >= 3 AND term NOT IN ({STOP}) GROUP BY term)"""
#: DuckDB counts bytes in edit distances; each accented letter stands for one capital there.
PLAIN = lambda x: f"translate({x}, 'äöüßáéíóúñèêçàâîôûëïùœæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
MISSES = f"""q(query_id, q) AS (VALUES {values(MISSPELT)}), qk AS (SELECT query_id, generate_subscripts({tok("q")}, 1) AS i, unnest({tok("q")}) AS token FROM q),
cand AS (SELECT DISTINCT token, term, levenshtein({PLAIN('token')}, {PLAIN('term')}) AS distance, weight FROM qk JOIN vocab ON abs(strlen(token) - strlen(term)) <= 2 WHERE token NOT IN (SELECT term FROM vocab) AND levenshtein({PLAIN('token')}, {PLAIN('term')}) BETWEEN 1 AND 2 AND strlen(token) >= 4 AND token NOT IN ({STOP}))"""


@query(f"WITH {VOCAB}, {MISSES} SELECT token, term, distance::BIGINT AS distance, weight FROM cand")
def spell_candidates(spark, sf_dir):
    words = vocabulary.spell_words(corpus(spark, sf_dir))
    tokens = literal(spark, MISSPELT, "query_id long, q string").select(F.explode(T.tokenize(F.col("q"))).alias("token"))
    return vocabulary.spell_candidates(tokens, words).select("token", "term", F.col("distance").cast("long").alias("distance"), "weight")


@query(f"""WITH {VOCAB}, {MISSES}, best AS (SELECT token, first(term ORDER BY distance, weight DESC, term) AS term FROM cand GROUP BY token)
SELECT query_id::BIGINT AS query_id, string_agg(coalesce(term, token), ' ' ORDER BY i) AS corrected FROM qk LEFT JOIN best USING (token) GROUP BY query_id HAVING count(term) > 0""")
def spell_correct(spark, sf_dir):
    return vocabulary.correct(literal(spark, MISSPELT, "query_id long, q string"), vocabulary.spell_words(corpus(spark, sf_dir)))


PREFIXES = [(0, "th"), (1, "the er"), (2, "zzz"), (3, "de "), (4, "e")]


@query(f"""WITH {DOCS}, q(query_id, q) AS (VALUES {values(PREFIXES)}),
f AS (SELECT query_id, q, array_to_string([t for t in {tok("q")} if strlen(t) >= 2 OR regexp_matches(t, '[0-9]')], ' ') AS form FROM q),
ph AS (SELECT array_to_string([t for t in {tok("title")} if strlen(t) >= 2 OR regexp_matches(t, '[0-9]')], ' ') AS phrase, count(*) AS freq FROM docs GROUP BY 1),
wd AS (SELECT DISTINCT term AS word FROM (SELECT unnest({tok("title")}) AS term FROM docs) WHERE strlen(term) >= 2 AND term NOT IN ({STOP})),
s AS (SELECT query_id, phrase AS suggestion, 100000 + freq AS score FROM f JOIN ph ON starts_with(phrase, form) AND phrase <> form WHERE form <> ''
  UNION ALL SELECT query_id, substr(q, 1, length(q) - length(regexp_extract(q, '(\\S+)$', 1))) || word, 10000 FROM f JOIN wd ON starts_with(word, lower(regexp_extract(q, '(\\S+)$', 1))) AND word <> lower(regexp_extract(q, '(\\S+)$', 1)) WHERE form <> '' AND regexp_extract(q, '(\\S+)$', 1) <> ''),
u AS (SELECT query_id, suggestion, max(score) AS score FROM s GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, rank::BIGINT AS rank, suggestion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, encode(suggestion)) AS rank FROM u) WHERE rank <= 8""")
def suggest_prefix(spark, sf_dir):
    d = corpus(spark, sf_dir)
    out = vocabulary.complete(literal(spark, PREFIXES, "query_id long, q string"), vocabulary.title_words(d), vocabulary.title_phrases(d))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "suggestion")


@query(f"""WITH {QT}, {BM25}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
tk8 AS (SELECT query_id, unnest({tok("title")}) AS token FROM top JOIN docs USING (doc_id) WHERE rank <= 8)
SELECT query_id, token, count(*) AS n FROM tk8 WHERE strlen(token) >= 3 AND token NOT IN ({STOP}) AND token NOT IN (SELECT term FROM qt) GROUP BY ALL""")
def related_tokens(spark, sf_dir):
    hits = top10(_scores(spark, sf_dir, _terms(spark))).join(corpus(spark, sf_dir).select("doc_id", "title"), "doc_id")
    return vocabulary.related_tokens(hits, literal(spark, [(0, " ".join(TERMS))], "query_id long, q string"))


@query(f"""WITH {BENCH_TERMS}, {BM25}, lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
age AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY published DESC, doc_id) AS rank FROM lex JOIN docs USING (doc_id) WHERE rank <= 50),
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 2.0 / (60 + rank) FROM age)
SELECT query_id, doc_id, round(sum(part), 9) AS score FROM u GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    scores = _scores(spark, sf_dir, benchmark_terms(spark, sf_dir))
    lex = R.top(scores, 50, [F.desc(F.round("score", 9)), F.asc("doc_id")])
    dated = lex.drop("rank").join(corpus(spark, sf_dir).select("doc_id", "published"), "doc_id")
    age = R.top(dated, 50, [F.desc("published"), F.asc("doc_id")])
    return R.rrf([(lex, 1.0), (age, 2.0)]).select("query_id", "doc_id", F.round("score", 9).alias("score"))


AS_OF = 1767225600


@query(f"WITH {DOCS} SELECT doc_id, round(CASE WHEN published > 0 THEN 1 + 0.65 * exp(-greatest(({AS_OF} - published) / 86400.0, 0) / 90.0) ELSE 1 END, 9) AS score FROM docs")
def freshness_boost(spark, sf_dir):
    s = R.freshness(F.lit(1.0), F.col("published"), F.lit(AS_OF), "fresh")
    return corpus(spark, sf_dir).select("doc_id", F.round(s, 9).alias("score"))


INTENTS = [(0, "latest rust release"), (1, "python 2024 changes"), (2, "rust ownership"), (3, "windows 1999")]


@query("SELECT * FROM (VALUES (0::BIGINT, true), (1, true), (2, false), (3, false)) t(query_id, fresh)")
def freshness_intent(spark, sf_dir):
    return literal(spark, INTENTS, "query_id long, q string").select("query_id", R.wants_fresh(F.col("q")).alias("fresh"))


@query()
def hybrid_search(spark, sf_dir):
    """The whole engine, stemmed, with vectors, for known-item queries over every document."""
    docs = corpus(spark, sf_dir)
    embed = semantic.hash_embedder()
    vectors = semantic.embedded(semantic.passages(docs), embed)
    words = F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("q"))
    hits = Engine(I.build(docs, stemmed=True, unique=True).stored(), vectors, embed).search(q, Options(k=10))
    return hits.select("query_id", "rank", "doc_id", "url", F.round("score", 6).alias("score"), "snippet")


@query(f"""WITH {BENCH_TERMS}, {BM25}, lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
r AS (SELECT query_id, rank, doc_id, regexp_extract(url, '^https://([^/]*)', 1) AS host FROM lex JOIN docs USING (doc_id) WHERE rank <= 40),
t AS (SELECT query_id, host, count(*) FILTER (rank <= 8) AS n FROM r GROUP BY ALL), m AS (SELECT query_id, max(n) AS most, count(*) AS hosts FROM t GROUP BY 1), c AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT r.*, (c.n > 8 AND hosts > 1 AND most > 4 AND row_number() OVER (PARTITION BY r.query_id, host ORDER BY rank) > 2) AS late FROM r JOIN m USING (query_id) JOIN c USING (query_id)),
y AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS rank FROM x)
SELECT query_id, rank, doc_id FROM y WHERE rank <= 8""")
def host_diversify(spark, sf_dir):
    scores = _scores(spark, sf_dir, benchmark_terms(spark, sf_dir))
    lex = R.top(scores, 40, [F.desc(F.round("score", 9)), F.asc("doc_id")]).join(corpus(spark, sf_dir).select("doc_id", "url"), "doc_id").withColumn("q", F.lit("plain"))
    return shape.diversify(lex, 8).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


@query(f"WITH {DOCS} SELECT url, regexp_extract(url, '^https://([^/]*)', 1) AS host, upper(substr(regexp_extract(url, '^https://([^/]*)', 1), 1, 1)) AS mark FROM docs")
def source_labels(spark, sf_dir):
    return corpus(spark, sf_dir).select("url", urls.source_label(F.col("url")).alias("host"), urls.source_mark(F.col("url")).alias("mark"))
