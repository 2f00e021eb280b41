"""PII by bootstrapped contextual extraction, with DataFrame functions only.

1. Seeds: the base rules (fixed values) find emails, IPv4 addresses, card and phone numbers.
2. Every token with a digit or @ in it, of any length, is an instance. Its lexical patterns are the word
   before it, the word after it, and its own shape (digits as 9, runs of letters as a). Pattern-instance
   edges are counted over all documents, each pair once.
3. A pattern's confidence is the share of its instances that are accepted, which are the seeds at first;
   patterns with too few accepted instances or too low a confidence count for nothing. A context (an
   instance with the words at its sides) is trusted by one minus the product of its own patterns'
   doubts. An instance is accepted too if half of its different contexts or more reach TRUST, so what is met
   everywhere isn't accepted for a few chance neighbours. Both are worked out again until no instance
   is added; as none is ever given up, that ends.
4. Accepted tokens that no base rule covers become spans of kind ``context``.

A shape alone never reaches TRUST, nor does a word; it takes both, or two words, to trust a context.

Defined cases: null text counts as empty; a null doc_id is kept, ids of any type are; repeated rows are
scanned each by itself; an empty table gives an empty result; further columns are ignored. Base spans
are never changed by the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, id_key
from quern.llm.spans import SPAN, bare, count_of, found, joined, ordered

# Kinds in listed order and the limits of their tests.
KINDS = ["email", "ip", "card", "phone"]
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)
# The base patterns. A start inside a run that was tried from its first character can't succeed, so
# look-behinds skip those starts; repeats that nothing follows are possessive. Neither changes a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
STOP = r"\s|,;:\"'<>\[\]{}="
TOKEN = rf"(?<![^{STOP}])[^{STOP}0-9@]*+[0-9@][^{STOP}]*+"
LEAST_PATTERN = 3  # accepted instances that a pattern needs
LEAST_CONFIDENCE = {"b": 0.8, "a": 0.8, "s": 0.5}  # of words before, words after and shapes
MOST_CONFIDENCE = 0.89  # below TRUST
TRUST = 0.9
SHARE = 0.5  # of an instance's contexts that must reach it
NEAR = 200  # characters beside a token that are looked at first for its words


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check sum."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of one text, by kind as listed then start."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    email = found(text, "email", EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(found(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)))
    card = F.filter(found(text, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda s: F.length(digits(s)).between(*CARD_DIGITS) & luhn(digits(s)))
    phone = F.filter(found(text, "phone", PHONE, text.rlike(r"\+[0-9]")), lambda s: F.length(digits(s)).between(*PHONE_DIGITS))
    return F.concat(email, ip, card, phone)


def instances(text: Column) -> Column:
    """array<struct<start, stop, value, before, after, shape>> of the identifier-like tokens of a text."""
    tokens = found(text, "token", TOKEN, text.rlike("[0-9@]"))

    def word(gap: Column, near: Column, inside: str, whole: str) -> Column:
        """The word of a gap; only if its nearest part doesn't show one in full is all of it searched."""
        return F.lower(F.coalesce(F.nullif(F.regexp_extract(near, inside, 1), F.lit("")), F.regexp_extract(gap, whole, 1)))

    before = lambda g: word(g, F.right(g, F.lit(NEAR)), r"\W(\w+)\W*$", r"(\w+)\W*$")
    after = lambda g: word(g, F.left(g, F.lit(NEAR)), r"^\W*(\w+)\W", r"^\W*(\w+)")
    shape = lambda v: F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), r"\p{L}+", "a")
    bared = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.rtrim(t["value"], F.lit(".!?)")).alias("value"), before(t["gap"]).alias("before"), after(t["next"]).alias("after")))
    return F.transform(bared, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["value"].alias("value"), t["before"].alias("before"), t["after"].alias("after"), shape(t["value"]).alias("shape")))


def bootstrap(scratch: Scratch, found_in: DataFrame) -> DataFrame:
    """(value) of the identifiers that no base rule finds but trusted patterns do.

    ``found_in``: value, before, after, shape, seed. Edges are summed by pattern and value first, so a
    pattern or value that fills the corpus is one row from each task before the exchange. What is
    joined back to the edges is a table of its own, so that Spark can split a frequent pattern.
    """
    contexts = found_in.where("value <> ''").groupBy("value", "before", "after", "shape").agg(F.max("seed").alias("seed"))
    contexts = scratch.table(contexts, "contexts")
    sides = {"b": "before", "a": "after", "s": "shape"}
    pattern = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("word")) for side, c in sides.items())))
    edges = scratch.table(contexts.select("value", pattern.alias("p")).where("p.word <> ''").select("p.side", "p.word", "value").distinct(), "edges")
    seeds = scratch.table(contexts.groupBy("value").agg(F.max("seed").alias("seed")).where("seed").select("value"), "seeds")
    accepted, n = seeds, -1
    least = F.create_map(*(F.lit(x) for pair in LEAST_CONFIDENCE.items() for x in pair))
    while n != (now := accepted.count()):
        n = now
        marked = edges.join(accepted.withColumn("good", F.lit(1)), "value", "left")
        scored = marked.groupBy("side", "word").agg(F.count("good").alias("good"), F.count("*").alias("n"))
        conf = F.least(F.col("good") / (F.col("n") + 1), F.lit(MOST_CONFIDENCE))
        trusted = scored.where((F.col("good") >= LEAST_PATTERN) & (F.col("good") / F.col("n") >= least[F.col("side")])).select("side", "word", conf.alias("conf"))
        trusted = scratch.table(trusted, "patterns")
        judged, doubt = contexts.select("value", *sides.values()), F.lit(1.0)
        for side, c in sides.items():
            judged = judged.join(trusted.where(F.col("side") == side).select(F.col("word").alias(c), F.col("conf").alias(side)), c, "left")
            doubt = doubt * (1 - F.coalesce(side, F.lit(0.0)))
        reached = judged.groupBy("value").agg(F.avg((1 - doubt >= TRUST).cast("double")).alias("share")).where(F.col("share") >= SHARE).select("value")
        accepted = scratch.table(accepted.union(reached).distinct(), "accepted")
        scratch.drop(trusted)
    return accepted.join(seeds, "value", "left_anti")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id and spans (base ones by kind then start, then those found in context) of each row."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [id_key(docs).alias("dk"), F.xxhash64(text).alias("th")]
    first = docs.select("doc_id", *key, bare(base_spans(text)).alias("spans"), instances(text).alias("tokens"))
    first = scratch.table(first, "spans")
    covered = F.exists("spans", lambda s: (s["start"] < F.col("t.stop")) & (s["stop"] > F.col("t.start")))
    tokens = first.where(F.size("tokens") > 0).select("dk", "th", "spans", F.explode("tokens").alias("t")).select("dk", "th", "t.value", "t.before", "t.after", "t.shape", "t.start", covered.alias("seed"))
    tokens = scratch.table(tokens, "tokens")
    new = tokens.where(~F.col("seed")).join(scratch.table(bootstrap(scratch, tokens), "found"), "value")
    stop = F.col("start") + F.length("value")
    new = new.select("dk", "th", F.struct(F.lit("context").alias("kind"), "start", stop.alias("stop"), "value").alias("s")).groupBy("dk", "th").agg(F.collect_set("s").alias("more"))
    return first.drop("tokens").join(new, ["dk", "th"], "left").select("doc_id", F.concat("spans", F.coalesce("more", F.array().cast(SPAN))).alias("spans"))


def digest(by_row: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_context and n_spans (all kinds)."""
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS))
    return by_row.select("doc_id", *(count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(ordered(F.col("spans"), [*KINDS, "context"], by_kind=True)).alias("spans"), count_of(F.col("spans"), "context").alias("n_context"), F.size("spans").cast("long").alias("n_spans"))
