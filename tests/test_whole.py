"""Queries over whole tables: nothing is cut or left out."""

import pyarrow.parquet as pq

from quern.operators import links
from quern.plans import catalog


def test_snippets_of_whole_texts(spark, data):
    got = {r.doc_id: r.snippet for r in catalog.QUERIES["snippet_marked"](spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assert got.keys() == texts.keys()
    long = {i for i, t in texts.items() if len(t.split()) > 32}
    assert long and all(got[i].startswith("… ") or got[i].endswith(" …") for i in long)
    assert any(got[i].startswith("… ") and got[i].endswith(" …") for i in long)


def test_pagerank_of_all_orders(spark, data):
    read = lambda t, *c: [tuple(r.values()) for r in pq.read_table(f"{data}/{t}.parquet", columns=list(c)).to_pylist()]
    nation_of, seller = dict(read("customer", "c_custkey", "c_nationkey")), dict(read("supplier", "s_suppkey", "s_nationkey"))
    buyer = {o: nation_of[c] for o, c in read("orders", "o_orderkey", "o_custkey")}
    edges = [(buyer[o], seller[s]) for o, s in read("lineitem", "l_orderkey", "l_suppkey") if buyer[o] != seller[s]]
    nodes = [n for (n,) in read("nation", "n_nationkey")]
    out = {n: sum(a == n for a, _ in edges) for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    assert links.ROUNDS == 40
    for _ in range(links.ROUNDS):
        lost = sum(r for n, r in rank.items() if not out[n]) / len(nodes)
        new = {n: 0.15 / len(nodes) + 0.85 * lost for n in nodes}
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.doc_id: r.rank for r in catalog.QUERIES["pagerank_nations"](spark, data).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-8 for n in nodes)
