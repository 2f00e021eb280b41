"""The engine on small corpora whose order is known."""

import pytest

from quern.operators import index as I  # noqa: E741
from quern.operators import rank as R
from quern.operators import semantic, vocabulary
from quern.plans.queryparse import parse, words
from quern.plans.search import Engine, Options

DOCS = "doc_id long, url string, title string, text string"
LANGS = [(0, "https://a.org/x", "Rust Lang", "rust is a systems programming language"), (1, "https://b.org/docs/y", "Go Lang", "go is a language for concurrent network services"), (2, "https://c.org/z.pdf", "Rust Search", "building a search engine in rust rust rust")]


def urls(spark, docs, *queries, stemmed=True, **options):
    engine = Engine(I.build(spark.createDataFrame(docs, DOCS), stemmed))
    hits = engine.search(spark.createDataFrame(list(enumerate(queries)), "query_id long, q string"), Options(**options)).orderBy("query_id", "rank").collect()
    return [[h.url for h in hits if h.query_id == i] for i in range(len(queries))]


def test_ranking_and_operators(spark):
    a, b, c = (d[1] for d in LANGS)
    got = urls(spark, LANGS, "rust", "kubernetes", "language services", '"search engine"', "site:b.org", "rust -engine", "rust filetype:pdf", "language intitle:go", "the", "-rust", "rust inurl:x", '"engine search"')
    assert got == [[c, a], [], [b, a], [c], [b], [a], [c], [b], [], [], [a], []]


def test_stemming_title_weight_and_proximity(spark):
    rows = [(0, "u0", "Doc", "the system was connecting to peers"), (1, "u1", "Photosynthesis", "an unrelated body about weather"), (2, "u2", "Weather report", "a long note that mentions photosynthesis once"), (3, "u3", "N", "quantum computing is near " + "filler word " * 10), (4, "u4", "N", "quantum " + "filler word " * 10 + "computing is near")]
    got = urls(spark, rows, "connection", "photosynthesis", "quantum computing")
    assert got[0] == ["u0"] and got[1] == ["u1", "u2"] and got[2] == ["u3", "u4"]


def test_dates_and_filter_only(spark):
    docs = [(0, "https://e.org/old", "Old", "x", 1577836800), (1, "https://e.org/new", "New", "x", 1769904000), (2, "https://f.org/new", "New", "x", 1769904000)]
    engine = Engine(I.build(spark.createDataFrame(docs, DOCS + ", published long")))
    hits = engine.search(spark.createDataFrame([(0, "site:e.org after:2025-01-01")], "query_id long, q string")).collect()
    assert [h.url for h in hits] == ["https://e.org/new"]


def test_partitions_do_not_change_scores(spark):
    docs = spark.createDataFrame(LANGS, DOCS)
    q = spark.createDataFrame([(0, "rust language")], "query_id long, q string")
    one, many = (sorted((h.url, round(h.score, 9)) for h in Engine(I.build(docs.repartition(n), True)).search(q).collect()) for n in (1, 7))
    assert one == many and len(one) == 3


def test_exact_top_over_long_lists(spark):
    """A lone strong document in the middle of a long list comes first."""
    rows = [(i, f"u{i}", "", "alpha " * (40 if i == 200 else 1) + "pad " * 40) for i in range(400)] + [(10_000, "u10000", "", "beta " + "pad " * 40)]
    assert urls(spark, rows, "alpha beta", stemmed=False, k=1)[0][0] in ("u200", "u10000")
    assert urls(spark, rows, "alpha", stemmed=False, k=1) == [["u200"]]


def test_tombstones_compaction_and_reload(spark, tmp_path):
    index = I.build(spark.createDataFrame(LANGS, DOCS), True)
    dead = spark.createDataFrame([(1,)], "doc_id long")
    q = spark.createDataFrame([(0, "rust language"), (1, "concurrent")], "query_id long, q string")
    view = I.without(index, dead)
    want = sorted((h.query_id, h.url, round(h.score, 9)) for h in Engine(view).search(q).collect())
    small = I.compact(index, dead, str(tmp_path / "index"))
    assert sorted((h.query_id, h.url, round(h.score, 9)) for h in Engine(small).search(q).collect()) == want
    assert {u for _, u, _ in want} == {LANGS[0][1], LANGS[2][1]}


def test_update(spark):
    index = I.build(spark.createDataFrame([(0, "a", "A", "one"), (1, "b", "B", "two")], DOCS))
    store = spark.createDataFrame([("a", "A", "one more"), ("c", "C", "three")], "url string, title string, text string")
    new, status = I.apply_update(index, store, 100)
    assert {(r.url, r.status) for r in status.collect()} == {("a", "changed"), ("b", "deleted"), ("c", "added")}
    assert {r.url for r in new.documents.collect()} == {"a", "c"}
    assert all(i >= 100 for (i,) in new.documents.select("doc_id").collect())


def test_merge_to_convergence():
    assert I.converge({0: 2, 1: 1, 2: 2, 3: 1, 4: 100}, 3) == [[1, 3, 0], [2, 5]] or I.converge({0: 2, 1: 1, 2: 2, 3: 1, 4: 100}, 3)[0] == [1, 3, 0]


def test_vectors_and_answers(spark):
    docs = spark.createDataFrame(LANGS, DOCS)
    embed = semantic.hash_embedder()
    vectors = semantic.embedded(semantic.passages(docs), embed)
    hits = Engine(I.build(docs, True), vectors, embed).search(spark.createDataFrame([(0, "rust systems programming language")], "query_id long, q string"), Options(answer=True)).orderBy("rank").collect()
    assert hits[0].url == LANGS[0][1] and hits[0].answer.startswith("rust is a systems")


def test_did_you_mean_and_related(spark):
    rows = [(0, "https://a.org", "Rust ownership and borrowing", "rust ownership"), (1, "https://b.org", "Search engine ranking", "search engine")]
    engine = Engine(I.build(spark.createDataFrame(rows, DOCS), True))
    q = spark.createDataFrame([(0, "rust ownrship"), (1, "serch engne"), (2, "rust ownership"), (3, "zzzzzzzz")], "query_id long, q string")
    assert {(r.query_id, r.corrected) for r in engine.did_you_mean(q).collect()} == {(0, "rust ownership"), (1, "search engine")}
    one = spark.createDataFrame([(0, "rust")], "query_id long, q string")
    assert [r.q for r in engine.related(one, engine.search(one)).orderBy("rank").collect()] == ["rust borrowing", "rust ownership"]


def test_completion(spark):
    titles = spark.createDataFrame([(0, "Closures and Ownership"), (1, "Closing Channels"), (2, "Traits")], "doc_id long, title string")
    log = spark.createDataFrame([(1, "closures borrow checker"), (2, "closures  borrow checker"), (3, "!gh clo")], "seq long, q string")
    p = spark.createDataFrame([(0, "clo"), (1, "rust owne"), (2, " "), (3, "traits "), (4, "zzz")], "query_id long, q string")
    got = vocabulary.complete(p, vocabulary.title_words(titles), vocabulary.title_phrases(titles), vocabulary.session_queries(log)).orderBy("query_id", "rank").collect()
    by = {i: [r.suggestion for r in got if r.query_id == i] for i in range(5)}
    assert by[0][0] == "closures borrow checker" and {"closing", "closures"} <= set(by[0])
    assert by[1] == ["rust ownership"] and not by[2] and not by[3] and not by[4]


@pytest.mark.parametrize("text, parts", [('a "b c" d', ["a", '"b c"', "d"]), ('x:"y z"', ['x:"y z"']), ('"open a', ['"open a'])])
def test_words(text, parts):
    assert words(text) == parts


def test_parse():
    p = parse('rust OR ownership site:https://www.Doc.org/ -unsafe intitle:book filetype:.PDF inurl:/guide/ after:2025 before:junk "borrow the checker"')
    assert p["clean"] == 'rust ownership before:junk "borrow the checker"' and p["sites"] == ["doc.org"] and p["filetypes"] == ["pdf"] and p["inurls"] == ["guide"]
    assert p["after"] == 1735689600 and p["before"] is None and p["phrases"] == [[{"term": "borrow", "at": 0}, {"term": "checker", "at": 2}]]


def test_cover_span_matches_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for d in range(60):
        places = sorted(rng.sample(range(80), rng.randint(1, 14)))
        own = [(d, rng.choice("abc"), p) for p in places]
        rows += own
        by = {}
        for _, t, p in own:
            by.setdefault(t, []).append(p)
        want[d] = min(max(c) - min(c) for c in itertools.product(*by.values()))
    got = R.cover_spans(spark.createDataFrame([(0, *r) for r in rows], "query_id long, doc_id long, term string, pos int")).collect()
    assert {r.doc_id: r.span for r in got} == want
