"""Answer cards, in order of precedence: weather, percentages, unit conversion, calculator.

Arithmetic, percentages and units are worked out by a UDF over the (few) queries; the weather card is
a join of queries with records.
"""

from __future__ import annotations

import math
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CARD = "struct<label:string,title:string,value:string,detail:string>"
# Unit names, the label of one and of many, the dimension, and the factor to its base.
UNITS = """
m meter meters metre metres | meter | meters | length | 1
km kilometer kilometers kilometre kilometres | kilometer | kilometers | length | 1000
cm centimeter centimeters centimetre centimetres | centimeter | centimeters | length | 0.01
mm millimeter millimeters millimetre millimetres | millimeter | millimeters | length | 0.001
mi mile miles | mile | miles | length | 1609.344
ft foot feet | foot | feet | length | 0.3048
in inch inches | inch | inches | length | 0.0254
kg kilogram kilograms | kilogram | kilograms | mass | 1
g gram grams | gram | grams | mass | 0.001
lb lbs pound pounds | pound | pounds | mass | 0.45359237
oz ounce ounces | ounce | ounces | mass | 0.028349523125
c celsius | C | C | heat | 1
f fahrenheit | F | F | heat | 0.5555555555555556
k kelvin | K | K | heat | 1
"""
ZERO = {"C": 273.15, "F": 459.67, "K": 0.0}  # what is added before the factor, on the way to kelvin


def _units() -> dict[str, tuple]:
    out = {}
    for line in UNITS.strip().splitlines():
        names, one, many, kind, factor = (x.strip() for x in line.split("|"))
        out |= dict.fromkeys(names.split(), (one, many, kind, float(factor)))
    return out


UNIT_OF = _units()


def format_number(v: float) -> str:
    """An integer if within 1e-10 of one, else six decimals without closing zeros."""
    if abs(round(v) - v) < 1e-10:
        return str(int(math.floor(abs(v) + 0.5)) * (1 if v >= 0 else -1))
    return f"{v:.6f}".rstrip("0").rstrip(".")


def _number(text: str) -> float | None:
    try:
        v = float(text.strip().replace(",", ""))
    except ValueError:
        return None
    return v if math.isfinite(v) and "_" not in text else None




def evaluate(expression: str) -> float | None:
    """+ - * / ^ sqrt and parentheses; ^ groups to the right and a sign binds tighter than it."""
    tokens = re.findall(r"\d+\.?\d*|\.\d+|sqrt|[-+*/^()]", expression.lower())
    if "".join(tokens) != re.sub(r"\s+", "", expression.lower()):
        return None

    def chain(kinds: str, below):
        def run(i: int):
            v, i = below(i)
            while i < len(tokens) and tokens[i] in kinds:
                w, j = below(i + 1)
                v, i = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[tokens[i]](v, w), j
            return v, i

        return run

    def power(i: int):
        v, i = signed(i)
        if i < len(tokens) and tokens[i] == "^":
            w, i = power(i + 1)
            v = v**w
        return v, i

    def signed(i: int):
        if tokens[i] in "+-":
            v, j = signed(i + 1)
            return (-v if tokens[i] == "-" else v), j
        if tokens[i] == "sqrt":
            v, j = signed(i + 1)
            return math.sqrt(v), j
        if tokens[i] == "(":
            v, j = total(i + 1)
            if tokens[j] != ")":
                raise ValueError
            return v, j + 1
        return float(tokens[i]), i + 1

    total = chain("+-", chain("*/", power))
    try:
        v, end = total(0)
        return v if end == len(tokens) and isinstance(v, float) and math.isfinite(v) else None
    except (ArithmeticError, ValueError, IndexError, TypeError):
        return None


def calculator(query: str) -> dict | None:
    q = query.strip()
    plain = re.fullmatch(r"[\d\s.+\-*/^()]*", q) and re.search(r"[-+*/^()]", q)
    if not (q.lower().startswith("sqrt") or plain):
        return None
    v = evaluate(q)
    return None if v is None else {"label": "Calculator", "title": q, "value": format_number(v), "detail": None}


def percentage(query: str) -> dict | None:
    q = query.strip().rstrip("?").lower()
    for prefix in ("what is ", "what's ", "calculate ", "find "):
        if q.startswith(prefix):
            q = q[len(prefix) :].strip()
            break
    n = format_number
    of = q.split("%", 1) if "%" in q else [] if " is what percent of " in q else q.split(" percent of ", 1)
    if len(of) == 2:
        right = of[1].strip()
        if "%" in q:
            if not right.startswith("of"):
                return None
            right = right[2:]
        p, amount = _number(of[0]), _number(right)
        if p is None or amount is None:
            return None
        return {"label": "Percentage", "title": f"{n(p)}% of {n(amount)}", "value": n(p / 100 * amount), "detail": f"{n(p)} / 100 * {n(amount)}"}
    asked = q.split(" is what percent of ", 1)
    if len(asked) < 2 and q.startswith("what percentage is "):
        asked = q.removeprefix("what percentage is ").split(" of ", 1)
    if len(asked) < 2:
        return None
    part, whole = _number(asked[0]), _number(asked[1])
    if part is None or not whole:
        return None
    return {"label": "Percentage", "title": f"{n(part)} as a percentage of {n(whole)}", "value": f"{n(part / whole * 100)}%", "detail": f"{n(part)} / {n(whole)} * 100"}


def conversion(query: str) -> dict | None:
    parts = query.split()
    cut = next((i for i, p in enumerate(parts) if p.lower() in ("to", "in")), -1)
    if len(parts) < 4 or cut < 2 or cut + 1 >= len(parts):
        return None
    amount = _number(parts[0])
    a, b = (UNIT_OF.get(" ".join(x).lower()) for x in (parts[1:cut], parts[cut + 1 :]))
    if amount is None or a is None or b is None or a[2] != b[2]:
        return None
    if a[2] == "heat":
        v = (amount + ZERO[a[0]]) * a[3] / b[3] - ZERO[b[0]]
    else:
        v = amount * a[3] / b[3]
    name = lambda u, x: u[0] if abs(abs(x) - 1) < 1e-9 else u[1]
    left = f"{format_number(amount)} {name(a, amount)}"
    return {"label": "Unit conversion", "title": f"{left} to {name(b, v)}", "value": f"{left} = {format_number(v)} {name(b, v)}", "detail": None}


def local_card(query: Column) -> Column:
    """Percentage, conversion or calculator card of a query; null fields without one."""
    return F.pandas_udf(_cards, CARD)(query)


def card(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query_id and card of queries (query_id, q): weather first, then percentage, conversion, calculator; null without one."""
    weather = weather_cards(queries, records).withColumnRenamed("card", "first")
    local = queries.select("query_id", local_card(F.col("q")).alias("own"))
    own = F.when(F.col("own.label").isNotNull(), F.col("own"))
    return local.join(weather, "query_id", "left").select("query_id", F.coalesce("first", own).alias("card"))


def _cards(queries: pd.Series) -> pd.DataFrame:
    empty = {"label": None, "title": None, "value": None, "detail": None}
    return pd.DataFrame([(percentage(q) or conversion(q) or calculator(q) or empty) if q is not None else empty for q in queries], columns=list(empty))


def is_definition(query: Column) -> Column:
    return F.lower(F.ltrim(query)).rlike(r"^(define |definition of |what is |what are )\s*\S")


def is_weather(query: Column) -> Column:
    q = F.lower(query)
    return q.startswith("weather ") | (F.trim(q) == "weather") | F.contains(q, F.lit(" weather in ")) | q.startswith("temperature ") | F.contains(q, F.lit(" forecast"))


def weather_place(query: Column) -> Column:
    """What a weather query asks about; empty for the default place."""
    q = F.lower(F.trim(query))
    rest = F.regexp_replace(q, r"^(?:weather forecast (?:for|in)|weather (?:in|for|at)|weather|temperature (?:in|for)|temperature|forecast (?:in|for)|forecast) ", "")
    return F.when(q.isin("weather", "forecast", "temperature"), "").otherwise(F.regexp_replace(rest, r"^[?\s]+|[?\s]+$", ""))


def _key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def weather_cards(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query_id and card of the weather queries that a record (see sources.weather) answers.

    The first record whose name or alias contains the place, or is contained in it, answers; with no
    place asked for, the only record there is. Both tables are small: queries of one batch, one station list.
    """
    asked = queries.where(is_weather(F.col("q"))).select("query_id", _key(weather_place(F.col("q"))).alias("place"))
    only = records.agg(F.count("*").alias("n_records"))
    names = records.crossJoin(F.broadcast(only)).select("*", F.transform(F.concat(F.array("location"), F.coalesce("aliases", F.array().cast("array<string>"))), _key).alias("names"))
    hit = F.when(F.col("place") == "", F.col("n_records") == 1).otherwise(F.exists("names", lambda n: F.contains(n, F.col("place")) | F.contains(F.col("place"), n)))
    part = lambda name, lead="": F.when(F.col(name) != "", F.concat(F.lit(lead), F.col(name)))
    detail = F.concat_ws(" · ", part("condition"), part("feels_like", "Feels like "), part("humidity", "Humidity "), part("wind", "Wind "), part("updated", "Updated "), part("source", "Source "))
    found = asked.join(F.broadcast(names), hit)
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("record_id"))).where("rn = 1")
    return first.select("query_id", F.struct(F.lit("Weather").alias("label"), F.col("location").alias("title"), F.col("temperature").alias("value"), F.nullif(detail, F.lit("")).alias("detail")).alias("card"))
