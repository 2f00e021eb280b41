"""Publish dates: day-granular Unix seconds, 0 for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
YEARS = (1970, 3000)


def parse_published(text: Column) -> Column:
    """Seconds of the date in the first three runs of digits; month and day are clamped, 1 where missing.

    A year outside 1970 to 3000 gives 0. A day beyond its month rolls over into the next.
    """
    part = lambda i: F.substring(F.get(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), F.lit(i)), 1, 9).try_cast("int")
    year = part(0)
    month = F.least(F.greatest(F.coalesce(part(1), F.lit(1)), F.lit(1)), F.lit(12))
    day = F.least(F.greatest(F.coalesce(part(2), F.lit(1)), F.lit(1)), F.lit(31))
    fine = year.between(*YEARS)
    days = F.unix_date(F.make_date(F.when(fine, year), month, F.lit(1))) + day - 1
    return F.coalesce(F.when(fine, days.cast("long") * DAY), F.lit(0).cast("long"))


def format_date(seconds: Column) -> Column:
    """YYYY-MM-DD of Unix seconds; empty for 0."""
    return F.when(seconds > 0, F.date_format(F.date_from_unix_date(F.floor(seconds / DAY).cast("int")), "yyyy-MM-dd")).otherwise("")


def feed_date(text: Column) -> Column:
    """RFC 3339 in UTC of a feed's date, or the trimmed text where no layout fits."""
    raw = F.trim(text)
    short = F.regexp_replace(raw, r"\b(GMT|UTC|UT)$", "+0000")
    parsed = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")), *(F.try_to_timestamp(s, F.lit(f)) for s, f in ((F.regexp_replace(short, r"^[A-Za-z]{3}, *", ""), "d MMM yyyy HH:mm:ss Z"), (short, "d MMM yy HH:mm Z"))), F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.date_format(F.to_utc_timestamp(parsed, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), raw)
