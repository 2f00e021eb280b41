"""The corpus pipeline stage by stage on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_operators import brute_language, links_of, roots
from quern.llm import decontaminate, jaccard_join
from quern.llm.common import Scratch, WordIds, shingle_hashes, words_of


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    kept = {}
    scratch = Scratch(spark, "test-pipeline")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.table(stage(spark, now, data), name)
        kept[name] = now
        if name != "token_files":
            assert now.columns == docs.columns
    ids = lambda n: Counter(r.doc_id for r in kept[n].select("doc_id").collect())
    languages, first = ids("language_id"), ids("jaccard_join")
    assert set(first) == {r.doc_id for r in jaccard_join.join(kept["language_id"]).where("doc_id = component_id").collect()}
    assert set(first) < set(languages) and max(first.values()) == 1
    hit = {r.doc_id for r in decontaminate.hits(kept["jaccard_join"], bench).collect()}
    assert hit and set(ids("decontaminate")) == set(first) - hit
    assert set(ids("mixing")) == set(ids("decontaminate")) and sum(ids("mixing").values()) >= len(ids("decontaminate"))
    assert ids("token_files") == ids("mixing")
    rows = sorted((r.start, r.n_tokens) for r in kept["token_files"].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def plain_mixture(rows):
    """How often each row is taken: shares to the power a, bisected till no source is given more than twice."""
    tokens = Counter()
    for _, t, source in rows:
        tokens[source] += len((t or "").split())
    some = {s: n for s, n in tokens.items() if n}
    total = sum(some.values())

    def quotas(a):
        z = sum((n / total) ** a for n in some.values())
        weights = {s: (n / total) ** a / z for s, n in some.items()}
        size = max(n / weights[s] for s, n in some.items())
        return {s: w * size for s, w in weights.items()}

    fits = lambda a: max(q / some[s] for s, q in quotas(a).items()) <= 2 * (1 + 1e-12)
    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    while high and high - low > 2**-36:
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    quota = {s: math.floor(q + 0.5) for s, q in quotas(high).items()}
    place = lambda i: int(hashlib.md5(f"mix{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
    cut = {}
    for s, n in some.items():
        own, taken = sorted((place(i), len((t or "").split())) for i, t, x in rows if x == s), 0
        for p in sorted({p for p, _ in own}):
            taken += sum(k for q, k in own if q == p)
            if taken > quota[s] % n:
                cut[s] = p
                break
    return [(quota[s] // some[s] if s in some else 1) + (place(i) < cut.get(s, 0)) for i, _, s in rows]


def test_run_against_plain_stages(spark, tmp_path):
    """All five stages written plainly over a table with null and repeated ids, copies, items and odd texts."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    parts = {"en": ["th", "er", "on", "ing"], "fr": ["eau", "ou", "lle", "ré"]}
    say = lambda v, n: [" ".join("".join(rng.choice(parts[v]) for _ in range(rng.randint(1, 4))) for _ in range(n))][0]
    rows = [(i, say(v := ("en", "fr")[i % 2], rng.randint(5, 90)), v, ("a", "a", "a", "b", "c", None)[i % 6]) for i in range(120)]
    item = say("en", 30)
    near = rows[2][1].split() * 3
    rows += [(200, rows[0][1], "en", "b"), (None, rows[1][1], None, "a"), (None, say("fr", 40), "fr", "a"), (None, say("en", 50), None, "rare"), (7, say("en", 33), "en", "b")]
    rows += [(201, " ".join(near), "en", "c"), (202, " ".join([*near[:-1], "changed"]), "en", "c"), (203, say("en", 20) + " " + item + " " + say("en", 20), "en", "a"), (204, " ".join(item.split()[:-1]), "en", "a")]
    rows += [(205, None, "en", "a"), (206, "", "en", "a"), (207, "123 45", "en", "a"), (208, "中文 字", None, "a"), rows[5], rows[5]]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None), (2, "not in any text at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = [r for r, (lang, score) in zip(rows, brute_language([r[:3] for r in rows], [r[1] for r in rows])) if lang != "und" and score >= 0.5]
    hashes = {r.t: r.h for r in spark.createDataFrame([(r[1],) for r in known], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    links = links_of([r[1] for r in known])
    group = roots(links, list(range(len(known))))
    order = lambda i: (-(2**63) if known[i][0] is None else known[i][0], hashes[known[i][1]])
    first = {}
    for i in range(len(known)):
        if group[i] not in first or order(i) < order(first[group[i]]):
            first[group[i]] = i
    single = [known[i] for i in sorted(first.values())]
    ids = WordIds()

    def leaks(text):
        words = words_of(text)
        own = words_of(item)
        bag = Counter(shingle_hashes(own, ids).tolist())
        return any(decontaminate.similarity(Counter(shingle_hashes(words[p : p + len(own)], ids).tolist()), bag) >= 0.8 for p in range(max(0, len(words) - len(own)) + 1))

    clean = [r for r in single if not leaks(r[1])]
    copies = plain_mixture([(r[0], r[1], r[3]) for r in clean])
    plain = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    want = Counter()
    for r, n in zip(clean, copies):
        own = plain.encode(r[1], add_special_tokens=False).ids + [2]
        want[r[0], len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len(known) < len(rows) and len(single) < len(known) and len(clean) < len(single) and max(copies) == 2 and None in {r.doc_id for r in got}
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
