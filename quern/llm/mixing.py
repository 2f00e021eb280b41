"""Temperature mixing of sources: exponentiated shares, a bisected exponent, budgeted block permutations.

Weights are token shares to the power ``a``, normalised. ``a`` is bisected in [0, 1] until the mixture
meets a target entropy or, with none given, the greatest exponent of repetition is ``max_repeat``.
With ``budget="cover"`` the budget is the least that takes every document once, so sources are only
repeated and nothing is left out; a number is a budget in tokens.

A token is a run of characters other than white space: shares are wanted before any tokenizer is chosen.

A source's documents are permuted by a keyed hash, a place of 60 bits, and cut into blocks by the
place's leading bits. Each source gives all its documents ``floor(quota / tokens)`` times and then once
more the leading part of its permutation that fits the rest of the quota. Where the cut falls is found
block by block, then by ever smaller blocks inside the one that is cut, each from summed tokens: no
source is gathered or sorted anywhere, however large it is. ``realise`` returns the rows by epoch, then
block, then place: as places are spread evenly in every source, sources are interleaved in proportion
and copies of a document lie an epoch apart.

Defined cases: null source is a source of its own; null or empty text has 0 tokens and, as it costs
nothing, follows its place in the permutation; rows that tie in the hash (repeated rows and rows of one
doc_id) are taken or left together; a null doc_id has a place like any other; an empty table gives an
empty result; further columns are kept, whatever their names, but those that ``mix`` itself adds are
replaced. The exponent is 1 where no exponent in [0, 1] meets the aim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import Scratch, parts_for

MAX_REPEAT = 2.0
LEVELS = 5  # bisections that one pass over the sources decides
PASSES = 7
BITS = 12  # of the hash that one round of cutting reads
SEED = "mix"
BYTES = 8  # of text to a token, about, for the number of partitions


def n_tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


def exponent(sources: DataFrame, budget: float | str, max_repeat: float, entropy: float | None) -> tuple[float, float, float]:
    """(a, sum of p^a, budget in tokens) for ``sources`` (tokens > 0), by aggregates only."""
    total, least, most = sources.agg(F.sum("tokens").cast("double"), F.min("tokens").cast("double"), F.max("tokens").cast("double")).first()
    if not total:
        return 1.0, 1.0, 0.0
    p = F.col("tokens") / F.lit(total)

    def norms(exponents: list[float]) -> list[tuple[float, float]]:
        parts = [x for a in exponents for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        got = sources.agg(*(x.alias(f"x{i}") for i, x in enumerate(parts))).first()
        return list(zip(got[::2], got[1::2]))

    def tokens(a: float, z: float) -> float:
        return z * total * max((x / total) ** (1 - a) for x in (least, most)) if budget == "cover" else float(budget)

    def met(a: float, z: float, logs: float) -> bool:
        """Whether ``a`` is large enough; both aims hold from some exponent on."""
        if entropy is not None:
            import math

            return math.log(z) - a * logs / z <= entropy
        return max(tokens(a, z) * (x / total) ** a / z / x for x in (least, most)) <= max_repeat * (1 + 1e-12)

    low, high = 0.0, 1.0
    first = norms([0.0])[0]
    if met(0.0, *first):
        return 0.0, first[0], tokens(0.0, first[0])
    for _ in range(PASSES):
        steps = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        for a, (z, logs) in zip(steps, norms(steps)):
            if met(a, z, logs):
                high = a
                break
            low = a
    z = norms([high])[0][0]
    return high, z, tokens(high, z)


def plan(docs: DataFrame, budget: float | str = "cover", max_repeat: float = MAX_REPEAT, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, places). sources: key, tokens, docs, weight, copies, cut: a document whose place is
    below ``cut`` has one copy more. places: the (key, place, tokens) of each row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(docs.select(key_of(), place_of(), n_tokens(F.col("text")).alias("tokens")), "places")
    sources = scratch.table(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    a, z, size = exponent(sources.where("tokens > 0"), budget, max_repeat, entropy)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    quota = F.round(weight * F.lit(size)).cast("long")
    copies = F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1)
    sources = sources.withColumn("weight", weight).withColumn("copies", copies.cast("long"))
    sources = sources.withColumn("rest", F.when(F.col("tokens") > 0, quota - F.col("copies") * F.col("tokens")).otherwise(0))
    sources = scratch.table(sources.withColumn("cut", F.lit(0).cast("long")), "sources")
    for bits in range(60 - BITS, -1, -BITS):
        block = F.shiftright("place", bits)
        inside = rows.join(sources.select("key", "cut", "rest"), "key").where((F.col("place") >= F.col("cut")) & (F.shiftright("place", bits + BITS) == F.shiftright("cut", bits + BITS)))
        sums = inside.groupBy("key", "cut", "rest", block.alias("block")).agg(F.sum("tokens").alias("tokens"))
        run = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # 2^BITS rows at most
        over = sums.withColumn("upto", F.sum("tokens").over(run)).where("upto > rest").groupBy("key").agg(F.min(F.struct("block", F.col("upto") - F.col("tokens"))).alias("x"))
        over = over.select("key", F.col("x.block").alias("block"), F.col("x.col2").alias("taken"))
        # Only a source without tokens has nothing over its rest; its cut stays at 0.
        moved = sources.join(over, "key", "left")
        sources = scratch.table(moved.select("key", "tokens", "docs", "weight", "copies", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft("block", bits), "cut").alias("cut")), "sources")
    return sources, rows


def key_of() -> Column:
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("key")


PLACE_BITS = 60


def place_of() -> Column:
    """The place of a document in its source's permutation: the first 60 bits of a keyed hash."""
    keyed = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(keyed.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place")


def shares(docs: DataFrame, names: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """row (the columns ``names`` of ``docs``), weight, copies, place of each row; and the sources of ``plan``."""
    sources, _ = plan(docs, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key_of(), place_of())
    share = sources.select("key", "weight", F.col("copies").alias("n"), "cut")
    return rows.join(share, "key").select("row", "weight", (F.col("n") + (F.col("place") < F.col("cut")).cast("long")).alias("copies"), "place"), sources


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source and any more) with mix_weight, mix_copies and mix_place."""
    names = [c for c in docs.columns if c not in ("mix_weight", "mix_copies", "mix_place")]
    return shares(docs, names, **options)[0].select("row.*", *(F.col(c).alias(f"mix_{c}") for c in ("weight", "copies", "place")))


def realise(docs: DataFrame, with_place: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, in the order of the mixture.

    ``with_place`` adds mix_epoch, mix_block and mix_place, which the order goes by.
    """
    names = [c for c in docs.columns if not with_place or c not in ("mix_epoch", "mix_block", "mix_place")]
    rows, sources = shares(docs, names, **options)
    tokens = sources.agg(F.sum(F.col("tokens") * (F.col("copies") + 1))).first()[0] or 0
    mixed = rows.where("copies > 0")
    every = mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"), "place")
    dealt = every.repartitionByRange(parts_for(docs.sparkSession, BYTES * tokens), "epoch", "place").sortWithinPartitions("epoch", "place")
    places = [F.col("epoch").alias("mix_epoch"), F.shiftright("place", PLACE_BITS - BITS).alias("mix_block"), F.col("place").alias("mix_place")]
    return dealt.select("row.*", *places[: 3 * with_place])


#: The mixture of ``plan`` with its standard options; a bisection of as many steps as there.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	

]+'))::BIGINT AS tokens,
  ('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null')), 1, {PLACE_BITS // 4}))::BIGINT AS place FROM documents),
s AS (SELECT key, sum(tokens)::BIGINT AS tokens FROM d GROUP BY key),
t AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS most, list(tokens::DOUBLE) AS each FROM s WHERE tokens > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS a
  UNION ALL SELECT i + 1, CASE WHEN met THEN lo ELSE a END, CASE WHEN met THEN a ELSE hi END, ((CASE WHEN met THEN lo ELSE a END) + (CASE WHEN met THEN a ELSE hi END)) / 2
  FROM (SELECT *, z * total * greatest(pow(least / total, 1 - a), pow(most / total, 1 - a)) * greatest(pow(least / total, a) / z / least, pow(most / total, a) / z / most) <= {MAX_REPEAT} * (1 + 1e-12) AS met
    FROM (SELECT b.*, t.*, list_sum([pow(x / total, a) for x in each]) AS z FROM b, t WHERE i <= {LEVELS * PASSES})) WHERE NOT (i = 0 AND met)),
e AS (SELECT hi AS a FROM b ORDER BY i DESC LIMIT 1),
f AS (SELECT CASE WHEN (SELECT max(i) FROM b) = 0 THEN 0.0 ELSE a END AS a FROM e),
m AS (SELECT f.a, total, z, z * total * greatest(pow(least / total, 1 - f.a), pow(most / total, 1 - f.a)) AS size FROM f, LATERAL (SELECT t.*, list_sum([pow(x / total, f.a) for x in each]) AS z FROM t) AS t),
w AS (SELECT key, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, a) / z ELSE 0.0 END AS weight, size FROM s, m),
c AS (SELECT *, CASE WHEN tokens > 0 THEN round(weight * size)::BIGINT // tokens ELSE 1 END AS n, CASE WHEN tokens > 0 THEN round(weight * size)::BIGINT % tokens ELSE 0 END AS rest FROM w),
r AS (SELECT d.doc_id, d.source, d.place, c.weight, c.n, c.rest, d.key, sum(d.tokens) OVER (PARTITION BY d.key ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN c USING (key)),
k AS (SELECT key, coalesce(min(place) FILTER (upto > rest), 0) AS cut FROM r GROUP BY key)
SELECT doc_id, source, round(weight, 9) AS weight, (n + (place < cut)::BIGINT)::BIGINT AS copies, place FROM r JOIN k USING (key)
"""
