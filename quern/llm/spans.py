"""Match offsets with SQL functions only: no Python, no Arrow, one pass of the JVM's regex engine.

Offsets are code points. They come from the lengths of the matches and of the pieces between them,
since ``regexp_extract_all`` and ``split`` walk a text with the same leftmost, non-overlapping finds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
EMPTY = "array<struct<kind:string,start:int,stop:int,value:string,inner:string,gap:string,next:string>>"
SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ends(lengths: Column) -> Column:
    """Running sums of an array of ints, by blocks, so that many matches don't cost their square."""
    part = lambda a, first, n: F.aggregate(F.slice(a, first, n), F.lit(0), lambda x, y: x + y)
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda k: part(lengths, k + 1, F.lit(BLOCK)))
    return let(sums, lambda s: let(F.transform(s, lambda _, j: part(s, F.lit(1), j)), lambda before: F.transform(lengths, lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int")) + part(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))


def found(text: Column, kind: str, pattern: str, likely: Column, group: int = 0) -> Column:
    """array<struct<kind, start, stop, value, inner, gap, next>> of all matches, in order.

    inner is capture ``group``; gap and next are the pieces of text before and after the match.
    ``likely`` is a cheap test that every text with a match passes. Null text counts as empty.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def located(g: Column, w: Column) -> Column:
        lengths = F.transform(w, lambda x, i: F.length(x) + F.length(F.get(g, i)))
        rows = F.arrays_zip(w.alias("w"), inner.alias("n"), let(lengths, ends).alias("stop"))
        one = lambda x, i: F.struct(F.lit(kind).alias("kind"), (x["stop"] - F.length(x["w"])).alias("start"), x["stop"].alias("stop"), x["w"].alias("value"), x["n"].alias("inner"), F.get(g, i).alias("gap"), F.get(g, i + 1).alias("next"))
        return F.transform(rows, one)

    return F.when(F.coalesce(likely, F.lit(False)), let(gaps, lambda g: let(whole, lambda w: located(g, w)))).otherwise(F.array().cast(EMPTY))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined; empty text for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """``spans`` by kind as listed then start, or by start then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keys = (lambda s: (rank(s), s["start"])) if by_kind else (lambda s: (s["start"], rank(s)))
    keyed = F.transform(spans, lambda s: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys(s))), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def bare(spans: Column) -> Column:
    """The spans without their surroundings, as they are stored."""
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
