"""Text analysis as column expressions: tokens, stop words, stems, snippets' words, escapes.

Everything is a built-in expression except the stemmer, an Arrow UDF over token arrays that keeps the
stems a worker has seen; it needs no exchange, unlike a join with a vocabulary table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = "a an and are as at be but by for from if in into is it no not of on or such that the their then there these they this to was we will with you your".split()
STORED_CHARS = 8000
_STOPS = frozenset(STOP_WORDS)
TOKEN_GAP = r"[^\p{IsAlphabetic}\p{N}]+"

# The suffix rules of the stemmer, first match in this order.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives null."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


def is_stop_word(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def positions(tokens: Column, offset: Column | int = 0) -> Column:
    """array<struct<term, pos>> of the tokens that are no stop words; stop words still count as places."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), (i + offset).alias("pos")))
    return F.filter(placed, lambda x: ~is_stop_word(x["term"]))


def terms(text: Column, stem_words: bool = False) -> Column:
    """The tokens of a text without stop words, stemmed or as they are."""
    kept = F.filter(tokenize(text), lambda t: ~is_stop_word(t))
    return stem_all(kept) if stem_words else kept


def _shape(word: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _m(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return word[-1:] == word[-2:-1] and _shape(word)[-1:] == "c"


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The first rule whose suffix fits decides, whether or not the rest is long enough."""
    for suffix, new in rules:
        if word.endswith(suffix):
            rest = word.removesuffix(suffix)
            return rest + new if _m(rest) >= least else word
    return word


_RULES = {k: [tuple((x + ":").split(":")[:2]) for x in v.split()] for k, v in {2: STEP2, 3: STEP3, 4: STEP4}.items()}


def porter(word: str) -> str:
    """Porter's stem of a word of more than two letters a to z; other tokens stay as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word.removesuffix(suffix) + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) else word
    else:
        cut = next((word.removesuffix(s) for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word.removesuffix(s))), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                cut += "e"
            elif _double_end(cut) and cut[-1] not in "lsz":
                cut = cut[:-1]
            elif _m(cut) == 1 and _short_end(cut):
                cut += "e"
            word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _RULES[2], 1), _RULES[3], 1)
    if any(word.endswith(s) for s, _ in _RULES[4]):
        word = _swap(word, _RULES[4], 2)
    elif word.endswith(("sion", "tion")) and _m(word[:-3]) >= 2:
        word = word[:-3]
    if word.endswith("e") and (_m(word[:-1]) > 1 or (_m(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


def stem_all(tokens: Column) -> Column:
    """Stems of token arrays."""
    return F.arrow_udf(_stems, "array<string>")(tokens)


def index_stems(tokens: Column) -> Column:
    """The same with null in the place of each stop word."""
    return F.arrow_udf(_index_stems, "array<string>")(tokens)


def _stems(tokens: pa.Array) -> pa.Array:
    return _mapped(tokens, lambda words: pa.array([None if w is None else porter(w) for w in words.to_pylist()], pa.string()))


def _index_stems(tokens: pa.Array) -> pa.Array:
    return _mapped(tokens, lambda words: terms_of(words, True))


def _mapped(lists: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Each distinct token of a batch of arrays is mapped once."""
    sizes = lists.value_lengths()
    coded = lists.flatten().dictionary_encode()
    ends = pa.array(np.append(0, np.cumsum(sizes.fill_null(0).to_numpy())).astype(np.int32))
    return pa.ListArray.from_arrays(ends, of(coded.dictionary).take(coded.indices), mask=lists.is_null())


def terms_of(words: pa.Array, stemmed: bool) -> pa.Array:
    """What an index holds for each token: null for a stop word, else its stem or itself."""
    return pa.array([None if w in _STOPS else porter(w) if stemmed else w for w in words.to_pylist()], pa.string())


def stored_text(text: Column) -> Column:
    """White space collapsed, first STORED_CHARS characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, STORED_CHARS)


def content_hash(title: Column, text: Column, *more: Column) -> Column:
    """A digest that changes with the content."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("")) for c in (title, text, *more))), 256)


def suggest_form(text: Column) -> Column:
    """Tokens of two bytes or more, or with a digit, joined by blanks; null where none is left."""
    kept = F.filter(tokenize(text), lambda t: (F.octet_length(t) >= 2) | t.rlike("[0-9]"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def log_form(text: Column) -> Column:
    """A query as the log keeps it: collapsed, 160 characters, lower case."""
    return F.lower(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 160))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def percent_encode(text: Column, plus: bool = False) -> Column:
    """Percent encoding that leaves letters, digits and -_.~ as they are; blanks as %20, or + with ``plus``."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return out if plus else F.replace(out, F.lit("+"), F.lit("%20"))


def percent_decode(text: Column) -> Column:
    """The inverse of the + form; malformed escapes give null."""
    return F.try_url_decode(text)


def passages(text: Column, words_per: int = 150, most: int = 6, overlap: int = 0) -> Column:
    """Windows of ``words_per`` words that step by ``words_per - overlap``, up to ``most`` of them."""
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")
    step = max(1, words_per - overlap)
    n = F.size(words)
    count = F.least(F.lit(most), F.when(n == 0, 0).when(n <= words_per, 1).otherwise(F.ceil((n - words_per) / step) + 1)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, words_per), " "))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often and wherever ``of`` looks at it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def word_flags(words: Column, query_terms: Column) -> Column:
    """1 for each word that holds a token among the terms, else 0; only words that contain a term's letters are tokenized."""
    near = lambda w: F.exists(query_terms, lambda t: F.contains(F.lower(w), t))
    return F.transform(words, lambda w: (near(w) & F.arrays_overlap(tokenize(w), query_terms)).cast("int"))


def best_window(flags: Column, width: int) -> Column:
    """Start of the first window of ``width`` flags (0 or 1) that holds the most; 0 for short arrays.

    The first best window ends with a match, or is the first of all; so windows are counted at matches alone,
    each over the ``width`` matches before it at most.
    """
    found = F.filter(F.transform(flags, lambda f, i: F.when(f == 1, i)), lambda i: i.isNotNull())

    def ending(hits: Column, at: Column, j: Column) -> Column:
        inside = F.filter(F.slice(hits, F.greatest(j - (width - 2), F.lit(1)), width), lambda x: (x > at - width) & (x <= at))
        return F.struct(F.size(inside).alias("n"), (-F.greatest(at - (width - 1), F.lit(0))).alias("back"))

    most = let(found, lambda hits: F.array_max(F.transform(hits, lambda at, j: ending(hits, at, j))))
    return F.coalesce(-most["back"], F.lit(0))


def snippet(text: Column, query_terms: Column, width: int = 32, mark: bool = True, stem_words: bool = False) -> Column:
    """The window of ``width`` words with most matches; with ``mark``, escaped, matches in <mark>."""
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")

    def shown(x: Column, at: Column) -> Column:
        part = lambda c: F.slice(x[c], at + 1, width)
        if not mark:
            return F.array_join(part("w"), " ")
        marked = F.zip_with(part("w"), part("f"), lambda w, f: F.when(f == 1, F.concat(F.lit("<mark>"), html_escape(w), F.lit("</mark>"))).otherwise(html_escape(w)))
        return F.concat(F.when(at > 0, "… ").otherwise(""), F.array_join(marked, " "), F.when(at + width < F.size(x["w"]), " …").otherwise(""))

    pair = lambda w, f: F.struct(w.alias("w"), f.alias("f"))
    of = lambda x: let(best_window(x["f"], width), lambda at: shown(x, at))
    if stem_words:
        return let(pair(words, F.transform(stem_words_of(words), lambda ts: F.arrays_overlap(ts, query_terms).cast("int"))), of)
    return let(words, lambda ws: let(pair(ws, word_flags(ws, query_terms)), of))


def stem_words_of(words: Column) -> Column:
    """The stems of the tokens inside each word."""
    return F.pandas_udf(_word_stems, "array<array<string>>")(words)


def _word_stems(words: pd.Series) -> pd.Series:
    import re

    gap = re.compile(r"[\W_]+")
    return words.map(lambda ws: None if ws is None else [[porter(t) for t in gap.split(w.lower()) if t] for w in ws])
