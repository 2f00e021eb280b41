"""URL parts and forms by regular expressions, which never fail on junk as URL parsers may."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(url: Column) -> Column:
    """What follows the scheme, or all of it."""
    return F.regexp_replace(url, r"^[^:]*?://", "")


def _host(rest: Column) -> Column:
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", ""), r"^(?:www\.)+", ""))


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and www.; null without a scheme."""
    return F.when(F.contains(url, F.lit("://")), F.nullif(_host(F.regexp_replace(url, r"^.*?://", "")), F.lit("")))


def canonical_url(url: Column) -> Column:
    """host + path and query, without fragment and closing slashes; the path keeps its case."""
    plain = _rest(F.trim(F.regexp_replace(url, r"#.*$", "")))
    return F.concat(_host(plain), F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*(.*)$", 1), r"/+$", ""))


def site_path(url: Column) -> Column:
    """host + lower-case path without query, fragment and closing slashes."""
    plain = _rest(F.trim(F.regexp_replace(url, r"#.*$", "")))
    path = F.regexp_extract(plain, r"^[^/]*(/[^?#]*)", 1)
    return F.concat(_host(plain), F.lower(F.regexp_replace(path, r"/+$", "")))


def site_filter(site: Column) -> Column:
    """The form in which a ``site:`` value is held against ``site_path``."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(site), r"^(?:https://)+", ""), r"^(?:http://)+", ""), r"^(?:www\.)+", "")
    return F.lower(F.regexp_replace(bare, r"^/+|/+$", ""))


def url_filetype(url: Column) -> Column:
    """Lower-case extension of the last path segment; null without one."""
    segment = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    ext = F.regexp_extract(segment, r"\.([^.]*)$", 1)
    return F.nullif(F.lower(F.regexp_replace(ext, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")), F.lit(""))


def crawl_form(url: Column) -> Column:
    """http(s) only: lower-case scheme and host, no fragment, / for no path; null otherwise."""
    plain = F.trim(F.regexp_replace(url, r"#.*$", ""))
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def _no_dots(path: Column) -> Column:
    """``path`` (from /) without . and .. segments, by one fold over its segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve(base: Column, ref: Column) -> Column:
    """An absolute http(s) URL without fragment from a page's URL and a reference; null for others."""
    ref = F.trim(F.regexp_replace(ref, r"#.*$", ""))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base_path, r"^/(.*/)", 1))
    path, query = F.regexp_extract(ref, r"^([^?]*)", 1), F.regexp_extract(ref, r"(\?.*)$", 1)
    base_query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    absolute = F.concat(F.lower(F.regexp_extract(ref, r"^([^:]*)", 1)), F.regexp_replace(ref, r"^[^:]*", ""))
    full = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), absolute)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref == "", F.concat(origin, base_path, base_query))
        .when(ref.startswith("?"), F.concat(origin, base_path, ref))
        .when(ref.startswith("/"), F.concat(origin, _no_dots(path), query))
        .otherwise(F.concat(origin, _no_dots(F.concat(folder, path)), query))
    )
    return F.when(full.rlike(r"^https?://"), full)


def is_safe(url: Column) -> Column:
    """http(s) without line breaks."""
    return url.rlike(r"^(?i:https?)://") & ~url.rlike(r"[\r\n]")


def source_label(url: Column) -> Column:
    return F.coalesce(url_host(url), url)


def source_mark(url: Column) -> Column:
    """The first letter or digit of the label, upper case."""
    return F.upper(F.regexp_extract(source_label(url), r"([\p{L}\p{N}])", 1))
