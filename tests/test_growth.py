"""Work that grows no faster than its input, with the results of the plain form."""

import collections
import itertools
import random
import re
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import index as I  # noqa: E741
from quern.operators import rank as R
from quern.operators import semantic
from quern.plans import catalog
from quern.plans.queryparse import parsed
from quern.plans.search import Engine

DOCS = "doc_id long, url string, title string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_of_a_long_text(spark, tmp_path):
    """The title is not worked out again for each token: that took hours for a text like this."""
    text = " ".join(f"word{i % 5000}" for i in range(60_000))
    spark.createDataFrame([(0, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    row = catalog.QUERIES["token_positions"](spark, str(tmp_path)).first()
    assert time.time() - began < 30
    assert (row.n, row.first_pos, row.last_pos) == (60_008, 0, 60_000 + 8 + I.FIELD_GAP - 1)


def plain_postings(docs, stemmed):
    out = collections.defaultdict(list)
    for doc_id, _, title, text in docs:
        parts = [[t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for x in (title, text)]
        for field, tokens in enumerate(parts):
            for i, t in enumerate(tokens):
                if t not in T.STOP_WORDS:
                    out[T.porter(t) if stemmed else t, doc_id].append((field, i + field * (len(parts[0]) + I.FIELD_GAP)))
    return {k: (sum(f == 0 for f, _ in v), sum(f for f, _ in v), sorted(p for _, p in v)) for k, v in out.items()}


def test_postings_without_an_exchange(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "running", "runs", "été", "x1", "connected", "of", "connection", "deep-sea", "lake"]
    docs = [(i, f"u{i}", " ".join(rng.choices(words, k=i % 4)) if i % 5 else None, " ".join(rng.choices(words, k=i % 23)) if i % 7 else None) for i in range(60)]
    monkeypatch.setattr(I, "MOST_PLACES", 50)
    for stemmed in (False, True):
        built = I.build(spark.createDataFrame(docs, DOCS).repartition(3), stemmed, unique=True)
        assert "Exchange" not in plan(built.postings).replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0]
        want = plain_postings(docs, stemmed)
        assert {(r.term, r.doc_id): (r.tf_title, r.tf_body, r.positions) for r in built.postings.collect()} == want
        asked = spark.createDataFrame([("lake",), ("run",), ("runs",), ("none",)], "term string")
        found = {(r.term, r.doc_id): (r.tf_title, r.tf_body, r.positions) for r in built.of_terms(asked).collect()}
        assert found == {k: v for k, v in want.items() if k[0] in ("lake", "run", "runs")}
        lengths = {r.doc_id: r.len_title + r.len_body for r in built.documents.collect()}
        assert lengths == {d[0]: sum(len(v[2]) for k, v in want.items() if k[1] == d[0]) for d in docs}


def test_look_up_reads_no_text_again(spark):
    """Scores of a few terms come from what was looked up once; filters that no query has look nothing up."""
    docs = spark.createDataFrame([(i, f"https://a.org/{i}", "a title", f"lake {i} river") for i in range(20)], DOCS)
    built = I.build(docs, unique=True)
    found = R.matches(built, spark.createDataFrame([(0, "lake")], "query_id long, term string"))
    assert "split(" not in plan(found) and found.count() == 20
    q = parsed(spark.createDataFrame([(0, "lake")], "query_id long, q string"), False)
    every = built.documents.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    kept = Engine(built)._phrases(Engine(built)._filtered(every, q, built.documents), q)
    assert "split(lower" not in plan(kept) and "MapInArrow" not in plan(kept) and kept.count() == 20


def test_tombstones_of_what_is_looked_up(spark):
    docs = spark.createDataFrame([(i, f"u{i}", "t", "lake") for i in range(9)], DOCS)
    view = I.without(I.without(I.build(docs, unique=True), spark.createDataFrame([(1,)], "doc_id long")), spark.createDataFrame([(2,), (1,)], "doc_id long"))
    asked = spark.createDataFrame([("lake",)], "term string")
    assert sorted(r.doc_id for r in view.of_terms(asked).collect()) == [0, 3, 4, 5, 6, 7, 8]
    more = I.union(view, I.build(spark.createDataFrame([(20, "v", "t", "lake")], DOCS), unique=True))
    assert sorted(r.doc_id for r in more.of_terms(asked).collect()) == [0, 3, 4, 5, 6, 7, 8, 20]


def test_best_window_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [[int(rng.random() < p) for _ in range(n)] for n, p in itertools.product((0, 1, 5, 6, 7, 40, 200), (0, 0.05, 0.4, 1))]

    def first_best(flags, width=6):
        starts = range(max(len(flags) - width, 0) + 1)
        return max(starts, key=lambda i: (sum(flags[i : i + width]), -i)) if len(flags) >= width else 0

    got = spark.createDataFrame(list(enumerate(rows)), "i int, f array<int>").select("i", T.best_window(F.col("f"), 6).alias("at")).collect()
    assert {r.i: r["at"] for r in got} == {i: first_best(f) for i, f in enumerate(rows)}


def test_snippets_work_their_words_out_once(spark):
    """A long text's words are split, flagged and searched once each."""
    text = " ".join(f"w{i}" for i in range(30_000)) + " deep-sea lake " + "end " * 40
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(T.snippet(F.col("text"), F.array(F.lit("lake"), F.lit("sea"))).alias("s")).first().s
    assert time.time() - began < 20 and got.startswith("… w29970") and got.endswith("<mark>deep-sea</mark> <mark>lake</mark> …")


def vector_rows(n, dim=6, seed=4):
    rng = random.Random(seed)
    rows = [(i, i % 3, [float(rng.randint(-2, 2)) for _ in range(dim)]) for i in range(n)]
    return rows + [(n, 0, [1.0]), (n + 1, 0, [2.0, 1.0])]


def test_nearest_in_small_tiles(spark, monkeypatch):
    """However small tiles and batches are, ties and other lengths come out as in the plain form."""
    monkeypatch.setattr(semantic, "TILE", 3)
    monkeypatch.setattr(semantic, "MOST_PAIRS", 21)
    rows = vector_rows(90)
    vectors = spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, embedding array<float>").repartition(3)
    asked = [(i, v) for i, _, v in rows[:11]]
    queries = spark.createDataFrame(asked, "query_id long, qv array<float>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if len(a) == len(b) else 0.0
    want = {(q, r, d) for q, a in asked for r, (s, d) in enumerate(sorted((-dot(a, v), i) for i, _, v in rows)[:7], 1)}
    assert {(r.query_id, r["rank"], r.doc_id) for r in semantic.nearest(queries, vectors, 7).collect()} == want
    batches = [pd.DataFrame({"doc_id": [i for i, _, _ in rows], "embedding": [np.array(v) for _, _, v in rows]})]
    sent = list(semantic._nearest_in(iter(batches), np.arange(11), np.array([v for _, v in asked]), 7, 9, None))
    assert max(map(len, sent)) <= 3 * (7 + semantic.SPARE)


def test_pooled_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(semantic, "MOST_PAIRS", 50)
    rows = vector_rows(60)
    vectors = spark.createDataFrame([(i % 7, i, v) for i, _, v in rows], "doc_id long, passage_idx long, embedding array<float>").repartition(2)
    queries = spark.createDataFrame([(i, v) for i, _, v in rows[:11]], "query_id long, qv array<float>")
    shape = lambda df: {tuple(r) for r in df.select("query_id", "doc_id", "score", "passage_idx").collect()}
    assert shape(semantic.pooled(queries, vectors)) == shape(semantic.max_pooled(semantic.similarities(queries, vectors)).where("score > 0"))


def test_approximate_without_a_join_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(semantic, "TILE", 4)
    monkeypatch.setattr(semantic, "MOST_PAIRS", 40)
    rows = vector_rows(80)
    vectors = spark.createDataFrame([(i // 2, i, v) for i, _, v in rows], "doc_id long, passage_idx long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, _, v in rows[:9]], "query_id long, qv array<float>")
    shape = lambda df: {(r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect()}
    got = semantic.approximate(queries, vectors, 6, 5, tables=3, bits=4)
    assert shape(got) == shape(R.top(semantic.approximate_pooled(queries, vectors, 6, 3, 4), 5))
    assert "bucket" not in plan(got)


ODD = [" lead", "end \n", "a\r\nb\rc", "\\r \\b\\\\ ", "", None, '"q" ', "\n\nx", "plain\n\ntext", "form: none", " "]


def odd_documents(spark, path, first=0):
    rows = [(first + i, t, "en", "src1", 1) for i, t in enumerate(ODD * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows


def test_odd_texts_survive_the_record_format(spark, tmp_path):
    import hashlib

    rows = odd_documents(spark, tmp_path)
    got = {r.url.rpartition("/")[2]: r.digest for r in catalog.QUERIES["record_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {str(i): None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t, *_ in rows}


def test_update_of_great_ids_and_null_texts(spark, tmp_path):
    """Ids beyond the first new one are not taken for new, nor given twice."""
    rows = odd_documents(spark, tmp_path, 5 << 40)
    got = {r.url: r.part for r in catalog.QUERIES["update_applied"](spark, str(tmp_path)).collect()}
    assert got == {f"u{i}": "new" if i % 5 == 2 or (i % 7 == 0 and i % 5 != 1) else "old" for i, *_ in rows if i % 5 != 1}
