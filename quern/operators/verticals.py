"""Verticals: images, fresh, docs, code and sites, as predicates over url, title, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import shortcuts, urls

# What marks a documentation, code or fresh page; the first group is about the host.
DOCS_HOST, DOCS_HOST_START = ["docs.", "developer.", "cppreference", "pkg.go.dev"], ["doc."]
DOCS_URL = ["/docs/", "/doc/", "/reference/", "/guide/", "/book/", "/manual/"]
DOCS_TITLE = ["documentation", "reference", "guide", "manual"]
CODE_HOST = ["github.com", "gitlab.", "crates.io", "npmjs.com", "pypi.org", "pkg.go.dev"]
CODE_URL, CODE_URL_END = ["/src/", "/source/", "/api/"], [".rs", ".go", ".py", ".js"]
CODE_TITLE = ["api", "module", "package"]
CODE_TEXT = ["fn ", "func ", "class ", "const ", "import ", "package "]
FRESH_HOST_START = ["news.", "blog."]
FRESH_URL = ["/news/", "/blog/", "/posts/", "/articles/", "/press/", "/releases/", "/release-notes", "/changelog", "/changelogs/", "/updates/", "/announcements/", "/security/", "/advisories/", "/cve/", "/whats-new", "/what-s-new"]
FRESH_TITLE = ["release notes", "changelog", "change log", "security advisory", "announcing", "announcement", "released", "latest", "what's new", "whats new", "news", "update", "updates", "cve-"]
FRESH_TEXT = ["release notes", "changelog", "security advisory", "announcing", "what's new", "whats new", "published", "updated"]
FRESH_LEAD = 2000
LABELS = {
    "Security": ["security", "advisory", "advisories", "cve-", "cve/"],
    "Release": ["release notes", "release-note", "releases/", "released", "changelog", "change log", "changelogs/"],
    "Update": ["what's new", "whats new", "whats-new", "what-s-new", "update", "updates", "updated"],
    "News": ["news.", "/news/", "/blog/", "/posts/", "/articles/", "/press/", "announcing", "announcement", "news"],
}
# Names of the vertical parameter.
NAMES = {"images": "images", "fresh": "fresh", "news": "fresh", "docs": "docs", "code": "code", "sites": "sites"}


def named(value: str | None) -> str:
    """The vertical that a parameter names; ``all`` for others."""
    return NAMES.get((value or "").strip().lower(), "all")


def any_of(text: Column, needles: list[str], where: str = "contains") -> Column:
    return reduce(lambda a, b: a | b, (getattr(text, where)(n) for n in needles))


def _host(url: Column) -> Column:
    return F.coalesce(urls.url_host(F.lower(url)), F.lit(""))


def is_docs(url: Column, title: Column) -> Column:
    host = _host(url)
    return any_of(host, DOCS_HOST) | any_of(host, DOCS_HOST_START, "startswith") | any_of(F.lower(url), DOCS_URL) | any_of(F.lower(title), DOCS_TITLE)


def is_code(url: Column, title: Column, text: Column) -> Column:
    u = F.lower(url)
    return any_of(_host(url), CODE_HOST) | any_of(u, CODE_URL) | any_of(u, CODE_URL_END, "endswith") | any_of(F.lower(title), CODE_TITLE) | any_of(F.lower(text), CODE_TEXT)


def fresh_score(url: Column, title: Column, text: Column) -> Column:
    two = lambda c: F.when(c, 2).otherwise(0)
    lead = F.lower(F.substring(text, 1, FRESH_LEAD))
    return two(any_of(_host(url), FRESH_HOST_START, "startswith")) + two(any_of(F.lower(url), FRESH_URL)) + two(any_of(F.lower(title), FRESH_TITLE)) + any_of(lead, FRESH_TEXT).cast("int")


def fresh_label(url: Column, title: Column, text: Column, published: Column) -> Column:
    """Published for dated pages, else the first label that a fresh page's signals give; null for others."""
    hay = [F.lower(url), F.lower(title), F.lower(F.substring(text, 1, FRESH_LEAD))]
    label = F.when(published > 0, "Published").when(fresh_score(url, title, text) < 2, None)
    for name, needles in LABELS.items():
        label = label.when(reduce(lambda a, b: a | b, (any_of(h, needles) for h in hay)), name)
    return label.otherwise("Fresh")


def site_cards(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (url, title, ...) that are a known site's home; the 34 sites are broadcast."""
    known = shortcuts.sites(docs.sparkSession).select("home", "name", urls.site_filter(F.col("home")).alias("place"))
    hit = (F.col("url") == F.col("home")) | (F.lower("title") == F.lower("name")) | (urls.site_path(F.col("url")) == F.col("place"))
    return docs.join(F.broadcast(known), hit, "left_semi")


def vertical(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` (url, title, text, images, published) that a vertical shows."""
    u, t, x = F.col("url"), F.col("title"), F.col("text")
    if name == "images":
        return docs.where(F.size("images") > 0)
    if name == "fresh":
        return docs.where(fresh_label(u, t, x, F.col("published")).isNotNull())
    if name == "docs":
        return docs.where(is_docs(u, t))
    if name == "code":
        return docs.where(is_code(u, t, x))
    return site_cards(docs) if name == "sites" else docs
