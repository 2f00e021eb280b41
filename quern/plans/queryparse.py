"""The query language: words, "phrases", -word, site:, intitle:, filetype:, inurl:, after:, before:.

Queries are few beside documents, so they are parsed by a UDF into columns; all that follows is joins.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS, porter

PARSED = "struct<clean:string,terms:array<string>,phrases:array<array<struct<term:string,at:int>>>,excludes:array<string>,sites:array<string>,titles:array<string>,filetypes:array<string>,inurls:array<string>,after:bigint,before:bigint>"
_GAP = re.compile(r"[\W_]+")
_STOP = set(STOP_WORDS)


def places(text: str, stemmed: bool) -> list[tuple[str, int]]:
    """(term, place) of the tokens that are no stop words."""
    tokens = [t for t in _GAP.split(text.lower()) if t]
    return [(porter(t) if stemmed else t, i) for i, t in enumerate(tokens) if t not in _STOP]


def words(query: str) -> list[str]:
    """Parts between white space; quotes protect it, an open quote runs to the end."""
    return [m[0] for m in re.finditer(r'(?:[^\s"]|"[^"]*(?:"|$))+', query)]


def operator_date(text: str) -> int | None:
    """Seconds of a date, null for one that is none or not after 1970-01-01."""
    runs = [int(x) for x in re.findall("[0-9]+", text)[:3]]
    if not runs or not 1970 <= runs[0] <= 3000:
        return None
    month, day = (min(max(x, 1), most) for x, most in zip([*runs[1:], 1, 1], (12, 31)))
    if runs[0] > 2999:
        return None
    days = (date(runs[0], month, 1) + timedelta(day - 1) - date(1970, 1, 1)).days
    return days * 86_400 if days > 0 else None


def site_form(site: str) -> str:
    return re.sub(r"^(?:www\.)+", "", re.sub(r"^(?:http://)+", "", re.sub(r"^(?:https://)+", "", site.strip()))).strip("/").lower()


def parse(query: str, stemmed: bool = True) -> dict:
    """The columns of PARSED for one query; an operator that makes no sense is text."""
    clean: list[str] = []
    lists: dict[str, list] = {k: [] for k in ("excludes", "sites", "titles", "filetypes", "inurls")}
    dates: dict[str, int | None] = {"after": None, "before": None}
    plain = lambda text: [t for t, _ in places(text, stemmed)]
    for part in words(query):
        low = part.lower()
        name, colon, value = low.partition(":")
        if part.startswith('"'):
            clean.append(part)
        elif part.startswith("-") and len(part) > 1 and ":" not in part:
            lists["excludes"] += plain(part[1:])
        elif low == "or":
            continue
        elif colon and name == "site" and site_form(value):
            lists["sites"].append(site_form(value))
        elif colon and name == "intitle" and plain(part[8:]):
            lists["titles"] += plain(part[8:])
        elif colon and name == "filetype" and (ext := re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", value.strip())):
            lists["filetypes"].append(ext)
        elif colon and name == "inurl" and value.strip().strip("/"):
            lists["inurls"].append(value.strip().strip("/"))
        elif colon and name in dates and operator_date(value) is not None:
            dates[name] = operator_date(value)
        else:
            clean.append(part)
    text = " ".join(clean)
    terms: list[str] = []
    phrases = []
    pieces = text.split('"')
    for i, piece in enumerate(pieces):
        got = places(piece, stemmed)
        terms += [t for t, _ in got]
        if i % 2 and i < len(pieces) - 1 and len(got) >= 2:
            phrases.append([{"term": t, "at": p - got[0][1]} for t, p in got])
    unique = lambda xs: list(dict.fromkeys(xs))
    return {"clean": text, "terms": unique(terms), "phrases": phrases, **{k: unique(v) for k, v in lists.items()}, **dates}


def parsed(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """queries (query_id, q, ...) with the columns of PARSED."""

    @F.pandas_udf(PARSED)
    def run(q: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([parse(x or "", stemmed) for x in q], columns=[p.split(":")[0] for p in re.findall(r"\w+:(?=string|array|bigint)", PARSED) if p not in ("term:",)])
        return rows.astype({"after": "Int64", "before": "Int64"})

    return queries.withColumn("_p", run("q")).select(*queries.columns, "_p.*")
