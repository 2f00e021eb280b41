"""Queries over crawled pages: urls, extraction, verticals, feeds, robots, frontier, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates, html, urls
from quern.functions import text as T
from quern.operators import shape, verticals
from quern.plans.registry import literal, query, table, values
from quern.sources import feeds, records, sinks

REST = r"regexp_replace({0}, '^[^:]*?://', '')"
HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '^(www\.)+', '')"
PLAIN = r"trim(regexp_replace(url, '#.*$', ''))"
TAG = r"regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '[\t\n\f\r ]+', ' ', 'g'))"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _url_query(name, sql, f):
    def run(spark, sf_dir):
        return pages(spark, sf_dir).select("page_id", f(F.col("url")).alias("value"))

    run.__name__ = name
    query(f"SELECT page_id, {sql} AS value FROM pages")(run)


_url_query("url_host", f"nullif({HOST}, '')", urls.url_host)
_url_query("url_canonical", f"regexp_replace(regexp_replace(lower(regexp_extract({REST.format(PLAIN)}, '^([^/?#]*)', 1)), '^(www\\.)+', ''), ':.*$', '') || regexp_replace(regexp_extract({REST.format(PLAIN)}, '^[^/?]*(.*)$', 1), '/+$', '')", urls.canonical_url)
_url_query("url_site_path", f"regexp_replace(regexp_replace(lower(regexp_extract({REST.format(PLAIN)}, '^([^/?#]*)', 1)), '^(www\\.)+', ''), ':.*$', '') || lower(regexp_replace(regexp_extract({REST.format(PLAIN)}, '^[^/]*(/[^?#]*)', 1), '/+$', ''))", urls.site_path)
_url_query("url_filetype", r"nullif(lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\.([^.]*)$', 1)), '')", urls.url_filetype)
_url_query("crawl_normalize_url", r"lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://[^/?]*)', 1)) || CASE WHEN regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1)", urls.crawl_form)
_url_query("url_percent_encode", r"url_encode(url)", T.percent_encode)


@query(f"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract({REST.format(PLAIN)}, '^([^/?#]*)', 1)), '^(www\\.)+', ''), ':.*$', '') || regexp_replace(regexp_extract({REST.format(PLAIN)}, '^[^/?]*(.*)$', 1), '/+$', '') AS c FROM pages)
SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY c ORDER BY page_id) AS rn FROM p) WHERE rn = 1""")
def canonical_dedupe(spark, sf_dir):
    ranked = pages(spark, sf_dir).select(F.lit(0).alias("query_id"), F.col("page_id").alias("rank"), "url")
    return shape.dedupe(ranked).select(F.col("rank").alias("page_id"))


ENTITY_SQL = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(rf"SELECT page_id, {COLLAPSE.format(ENTITY_SQL.format(TAG.format(r'''regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)''')))} AS title FROM pages")
def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


def _chain(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return x


_NO_CONTENT = [rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in html.NO_CONTENT]
_BOILER = [html.NOISE, html.DROPPED] * 2
_QUOTE = lambda p: p.replace("'", "''")
READABLE = f"""WITH c AS (SELECT page_id, {_chain('html', _NO_CONTENT)} AS h FROM pages),
f AS (SELECT page_id, h, {" || ".join(f"regexp_extract_all(h, '{_QUOTE(p)}', 1)" for p in html.CANDIDATES)} AS fs FROM c),
u AS (SELECT page_id, generate_subscripts(fs, 1) AS i, unnest(fs) AS frag FROM f),
x AS (SELECT *, {COLLAPSE.format(ENTITY_SQL.format(TAG.format(_chain('frag', _BOILER))))} AS txt FROM u),
s AS (SELECT page_id, i, frag, len([w for w in string_split(txt, ' ') if w <> '']) + 12 * len(regexp_extract_all(frag, '(?i)<h[123]')) + 8 * len(regexp_extract_all(frag, '(?i)<(?:pre|code)')) - 6 * len(regexp_extract_all(frag, '{_QUOTE(html.HREF)}')) AS score FROM x WHERE strlen(txt) >= 80),
b AS (SELECT page_id, first(frag ORDER BY score DESC, i) AS best FROM s GROUP BY page_id)
SELECT page_id, md5({COLLAPSE.format(ENTITY_SQL.format(TAG.format(f"regexp_replace({_chain('coalesce(best, h)', _BOILER)}, '(?is)</?(?:{html.BLOCKS})[^>a-zA-Z0-9]?[^>]*>', ' ', 'g')")))}) AS digest FROM f LEFT JOIN b USING (page_id)"""
READABLE = READABLE.replace(rf"(?is)</?(?:{html.BLOCKS})[^>a-zA-Z0-9]?[^>]*>", rf"(?is)</?(?:{html.BLOCKS})\b[^>]*>")


@query(READABLE)
def html_readable_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(html.readable_text(F.col("html"))).alias("digest"))


@query(f"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/(?:[^?#]*/)?)', 1) AS folder,
  regexp_extract_all(html, '{_QUOTE(html.HREF)}', 1) AS a1, regexp_extract_all(html, '{_QUOTE(html.HREF)}', 2) AS a2, regexp_extract_all(html, '{_QUOTE(html.HREF)}', 3) AS a3 FROM pages),
h AS (SELECT page_id, scheme, origin, folder, trim(regexp_replace(raw, '#.*$', '')) AS href, raw FROM (SELECT page_id, scheme, origin, folder, coalesce(x1, '') || coalesce(x2, '') || coalesce(x3, '') AS raw FROM (SELECT *, unnest(a1) AS x1, unnest(a2) AS x2, unnest(a3) AS x3 FROM a))),
r AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN origin || href ELSE origin || coalesce(nullif(folder, ''), '/') || href END AS link FROM h WHERE raw <> '' AND NOT starts_with(raw, '#'))
SELECT DISTINCT page_id, link FROM r WHERE regexp_matches(link, '^https?://')""")
def html_links(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("page_id", F.explode(html.links(F.col("url"), F.col("html"))).alias("link"))


IMAGE_PAGE = '<head><title>T</title><meta property="og:image" content="/card.png"></head><img src="a.png" alt="A &amp; B"><img data-src="//cdn.x.org/b.png"><img srcset="c.png 1x, d.png 2x" title="C"><img src="a.png"><img src="data:image/png;base64,xx">'


@query("SELECT * FROM (VALUES (0::BIGINT, 'https://x.org/card.png', 'T'), (1, 'https://x.org/p/a.png', 'A & B'), (2, 'https://cdn.x.org/b.png', ''), (3, 'https://x.org/p/c.png', 'C')) t(i, url, alt)")
def html_images(spark, sf_dir):
    d = literal(spark, [("https://x.org/p/q.html", IMAGE_PAGE)], "url string, html string")
    found = html.images(F.col("url"), F.col("html"), html.title(F.col("html")))
    return d.select(F.posexplode(found).alias("i", "x")).select(F.col("i").cast("long").alias("i"), "x.url", "x.alt")


PUBLISHED = [(0, '<meta property="article:published_time" content="2024-05-06T07:08:09Z">'), (1, '<script>{"datePublished" : "2023-01-02"}</script>'), (2, "<time datetime='2022-03-04'>x</time>"), (3, "none")]


@query("SELECT * FROM (VALUES (0::BIGINT, '2024-05-06T07:08:09Z', 1714953600::BIGINT), (1, '2023-01-02', 1672617600), (2, '2022-03-04', 1646352000), (3, '', 0)) t(i, published, seconds)")
def html_published(spark, sf_dir):
    d = literal(spark, PUBLISHED, "i long, html string").select("i", html.published(F.col("html")).alias("published"))
    return d.withColumn("seconds", dates.parse_published(F.col("published")))


@query("SELECT * FROM (VALUES (0::BIGINT, 'Tim & Harry’s — done —'), (1, 'a & b &notanentity; x'), (2, '&#xD800; <')) t(i, value)")
def decode_entities(spark, sf_dir):
    d = literal(spark, [(0, "Tim &amp; Harry&rsquo;s &#8212; done &#x2014;"), (1, "a & b &notanentity; x"), (2, "&#xD800; &lt;")], "i long, x string")
    return d.select("i", html.decode_entities(F.col("x"), html.STORED_LIMIT).alias("value"))


def _any(col: str, needles: list[str], kind: str = "contains") -> str:
    f = {"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}[kind]
    return "(" + " OR ".join(f"{f}({col}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


PAGE_DOCS = rf"pd AS (SELECT page_id, lower(url) AS u, {HOST} AS h, lower({COLLAPSE.format(ENTITY_SQL.format(TAG.format(r'''regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)''')))}) AS t, html AS x FROM pages)"


def page_docs(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", html.title(F.col("html")).alias("title"), F.col("html").alias("text"), F.lit(0).cast("long").alias("published"))


#: Pages of many sites: url, title and text of each page by its id, so that every mark of a vertical occurs.
SITED = [
    ("https://docs.x.org/a", "plain", ""), ("https://developer.x.org/a", "plain", ""), ("https://en.cppreference.com/w", "plain", ""), ("https://pkg.go.dev/net", "plain", ""), ("https://doc.x.org/b", "plain", ""),
    ("https://x.org/docs/a", "plain", ""), ("https://x.org/Doc/a", "plain", ""), ("https://x.org/reference/a", "plain", ""), ("https://x.org/guide/a", "plain", ""), ("https://x.org/book/a", "plain", ""), ("https://x.org/manual/a", "plain", ""),
    ("https://x.org/1", "The Documentation", ""), ("https://x.org/2", "A Reference", ""), ("https://x.org/3", "User guide", ""), ("https://x.org/4", "Manual of arms", ""),
    ("https://github.com/o/r", "plain", ""), ("https://gitlab.x.org/o", "plain", ""), ("https://crates.io/crates/c", "plain", ""), ("https://www.npmjs.com/p", "plain", ""), ("https://pypi.org/project/p", "plain", ""),
    ("https://x.org/src/a", "plain", ""), ("https://x.org/source/a", "plain", ""), ("https://x.org/api/a", "plain", ""), ("https://x.org/a.rs", "plain", ""), ("https://x.org/a.go", "plain", ""), ("https://x.org/a.py", "plain", ""), ("https://x.org/a.js", "plain", ""),
    ("https://x.org/5", "An API", ""), ("https://x.org/6", "Module m", ""), ("https://x.org/7", "Package p", ""), ("https://x.org/8", "plain", "a fn main"), ("https://x.org/9", "plain", "a Func f"), ("https://x.org/10", "plain", "class C"), ("https://x.org/11", "plain", "const C"), ("https://x.org/12", "plain", "import os"), ("https://x.org/13", "plain", "package main"),
    ("https://news.x.org/a", "plain", "plain"), ("https://x.org/14", "plain", "function"), ("https://x.org/docx", "reverence", "imports"), ("https://x.org/a.rs.html", "mod", "fnord"),
]
IN_DOCS = [True] * 15 + [False] * 25
IN_CODE = [False, False, False, True] + [False] * 11 + [True] * 21 + [False] * 4


def sited(spark, sf_dir):
    rows = literal(spark, [(i, *r) for i, r in enumerate(SITED)], "n int, site string, title string, text string")
    of = pages(spark, sf_dir).select("page_id", (F.col("page_id") % len(SITED)).cast("int").alias("n"))
    return of.join(F.broadcast(rows), "n").select("page_id", F.col("site").alias("url"), "title", "text", F.lit(0).cast("long").alias("published"))


def _in(flags: list[bool]) -> str:
    return f"SELECT page_id FROM pages WHERE page_id % {len(SITED)} IN ({', '.join(str(i) for i, f in enumerate(flags) if f)})"


@query(_in(IN_DOCS))
def vertical_docs(spark, sf_dir):
    return verticals.vertical(sited(spark, sf_dir), "docs").select("page_id")


@query(_in(IN_CODE))
def vertical_code(spark, sf_dir):
    return verticals.vertical(sited(spark, sf_dir), "code").select("page_id")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0")
def vertical_images(spark, sf_dir):
    one = F.array(F.struct(F.lit("https://x.org/i.png").alias("url"), F.lit("").alias("alt")))
    docs = pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 3 == 0, one).otherwise(F.array().cast("array<struct<url:string,alt:string>>")).alias("images"))
    return verticals.vertical(docs.withColumns({"url": F.lit(""), "title": F.lit(""), "text": F.lit(""), "published": F.lit(0)}), "images").select("page_id")


LEAD = "lower(substr(x, 1, 2000))"
# Fixed values, spelt out for the SQL.
SQL_HOSTS = ['news.', 'blog.']
SQL_URLS = ['/news/', '/blog/', '/posts/', '/articles/', '/press/', '/releases/', '/release-notes', '/changelog', '/changelogs/', '/updates/', '/announcements/', '/security/', '/advisories/', '/cve/', '/whats-new', '/what-s-new']
SQL_TITLES = ['release notes', 'changelog', 'change log', 'security advisory', 'announcing', 'announcement', 'released', 'latest', "what's new", 'whats new', 'news', 'update', 'updates', 'cve-']
SQL_LEADS = ['release notes', 'changelog', 'security advisory', 'announcing', "what's new", 'whats new', 'published', 'updated']
SQL_LABELS = {
    'Security': ['security', 'advisory', 'advisories', 'cve-', 'cve/'],
    'Release': ['release notes', 'release-note', 'releases/', 'released', 'changelog', 'change log', 'changelogs/'],
    'Update': ["what's new", 'whats new', 'whats-new', 'what-s-new', 'update', 'updates', 'updated'],
    'News': ['news.', '/news/', '/blog/', '/posts/', '/articles/', '/press/', 'announcing', 'announcement', 'news'],
}
FRESH_SCORE = f"(2 * {_any('h', SQL_HOSTS, 'startswith')}::INT + 2 * {_any('u', SQL_URLS)}::INT + 2 * {_any('t', SQL_TITLES)}::INT + {_any(LEAD, SQL_LEADS)}::INT)"


@query(f"WITH {PAGE_DOCS} SELECT page_id, CASE WHEN {FRESH_SCORE} < 2 THEN NULL {' '.join(f'''WHEN {_any('u', n)} OR {_any('t', n)} OR {_any(LEAD, n)} THEN '{k}' ''' for k, n in SQL_LABELS.items())} ELSE 'Fresh' END AS label FROM pd")
def vertical_fresh_label(spark, sf_dir):
    d = page_docs(spark, sf_dir)
    return d.select("page_id", verticals.fresh_label(F.col("url"), F.col("title"), F.col("text"), F.col("published")).alias("label"))


FRESH_ROWS = [(0, "https://x.org/a", "Plain", "text", 1704067200), (1, "https://x.org/changelog", "Changelog", "fixes", 0), (2, "https://x.org/b", "Guide", "nothing", 0), (3, "https://x.org/c", "Security advisory CVE-1", "x", 0), (4, "https://blog.x.org/d", "Thoughts", "updated today", 0)]


@query("SELECT * FROM (VALUES (0::BIGINT, 'Published'), (1, 'Release'), (2, NULL), (3, 'Security'), (4, 'Update')) t(i, label)")
def fresh_label_cases(spark, sf_dir):
    d = literal(spark, FRESH_ROWS, "i long, url string, title string, text string, published long")
    return d.select("i", verticals.fresh_label(F.col("url"), F.col("title"), F.col("text"), F.col("published")).alias("label"))


SITE_ROWS = [(0, "https://github.com/", "x"), (1, "https://a.org", "youtube"), (2, "http://www.arxiv.org", "y"), (3, "https://github.com/rust", "z")]


@query("SELECT * FROM (VALUES (0::BIGINT), (1), (2)) t(i)")
def vertical_sites(spark, sf_dir):
    return verticals.vertical(literal(spark, SITE_ROWS, "i long, url string, title string"), "sites").select("i")


RSS = """<rss><channel><title>t</title><link>https://x.org</link><item><title>A</title><link>https://x.org/a</link><pubDate>Mon, 02 Jan 2006 15:04:05 -0700</pubDate></item>
<item><link>/b#frag</link><pubDate>junk</pubDate></item><item><link>https://x.org/a</link></item></channel></rss>"""
ATOM = """<feed><entry><link rel="self" href="/self"/><link rel="alternate" href="/c?x=1&amp;y=2"/><updated>2024-01-02T03:04:05+01:00</updated></entry></feed>"""
SITEMAP = """<urlset><url><loc>https://x.org/d</loc><lastmod>2024-05-06</lastmod></url></urlset>"""
INDEX = """<sitemapindex><sitemap><loc>/s1.xml</loc></sitemap><sitemap><loc>https://x.org/s2.xml</loc></sitemap></sitemapindex>"""
FEEDS = [("https://x.org/rss", RSS), ("https://x.org/atom", ATOM), ("https://x.org/map", SITEMAP), ("https://x.org/index", INDEX)]


@query("SELECT * FROM (VALUES ('https://x.org/rss', 'https://x.org/a', '2006-01-02T22:04:05Z'), ('https://x.org/rss', 'https://x.org/b', 'junk'), ('https://x.org/atom', 'https://x.org/c?x=1&y=2', '2024-01-02T02:04:05Z'), ('https://x.org/map', 'https://x.org/d', '2024-05-06T00:00:00Z')) t(base_url, url, published)")
def feed_entries(spark, sf_dir):
    return feeds.entries(literal(spark, FEEDS, "base_url string, body string")).select("base_url", "url", "published")


@query("SELECT * FROM (VALUES ('https://x.org/index', 'https://x.org/s1.xml'), ('https://x.org/index', 'https://x.org/s2.xml')) t(base_url, url)")
def feed_nested(spark, sf_dir):
    return feeds.nested(literal(spark, FEEDS, "base_url string, body string"))


FEED_DATES = [("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("Tue, 02 Jan 2024 03:04:05 +0200", "2024-01-02T01:04:05Z"), ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05Z"), ("02 Jan 24 03:04 +0000", "2024-01-02T03:04:00Z"), ("2024-01-02", "2024-01-02T00:00:00Z"), ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z"), ("Tue, 2 Jan 2024 03:04:05 -0700", "2024-01-02T10:04:05Z"), ("soon", "soon")]


@query(f"SELECT * FROM (VALUES {values(FEED_DATES)}) t(raw, date)")
def feed_dates(spark, sf_dir):
    return literal(spark, [(a,) for a, _ in FEED_DATES], "raw string").select("raw", dates.feed_date(F.col("raw")).alias("date"))


DATE_CASES = [("1970-01-02", 86400), ("2000-01-01", 946684800), ("2024-02-31T10:00:00Z", 1709337600), ("junk", 0), ("1850-01-01", 0), ("2024", 1704067200), ("2024-13-40", 1735603200), ("", 0)]


@query(f"SELECT raw, seconds::BIGINT AS seconds FROM (VALUES {values(DATE_CASES)}) t(raw, seconds)")
def parse_published(spark, sf_dir):
    return literal(spark, [(a,) for a, _ in DATE_CASES], "raw string").select("raw", dates.parse_published(F.col("raw")).alias("seconds"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, (epoch(date_trunc('day', ts)))::BIGINT AS seconds FROM events")
def format_date(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", dates.format_date(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"))
    return e.withColumn("seconds", dates.parse_published(F.col("day")))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: quernbot\nUser-agent: second\nDisallow: /private # no\nAllow: /private/open\nDisallow:\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /all\n"
PATHS = [("a", "/"), ("a", "/private/x"), ("a", "/private/open/y"), ("a", "/all"), ("b", "/all/x"), ("b", ""), ("c", "/x")]


@query("SELECT * FROM (VALUES ('a', '/', true), ('a', '/private/x', false), ('a', '/private/open/y', true), ('a', '/all', true), ('b', '/all/x', false), ('b', '', true), ('c', '/x', true)) t(host, path, permitted)")
def robots_permit(spark, sf_dir):
    rules = feeds.robots_rules(literal(spark, [("a", ROBOTS), ("b", "User-agent: *\nDisallow: /all")], "host string, body string"), "quernbot/0.1")
    return feeds.permitted(literal(spark, PATHS, "host string, path string"), rules)


@query(f"""WITH c AS (SELECT min(page_id) AS seen, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://[^/?]*)', 1)) || CASE WHEN regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1) AS url FROM pages GROUP BY 2),
h AS (SELECT seen, url, {HOST} AS host FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen, url) AS n FROM h WHERE url NOT IN (SELECT url FROM c WHERE seen % 10 = 0))
SELECT url, host, seen FROM k WHERE n <= 3 ORDER BY seen, url LIMIT 40""")
def crawl_frontier(spark, sf_dir):
    found = pages(spark, sf_dir).select("url", F.col("page_id").alias("seen"))
    known = found.select(urls.crawl_form(F.col("url")).alias("url"), "seen").groupBy("url").agg(F.min("seen").alias("seen"))
    hosts = known.select(urls.url_host(F.col("url")).alias("host"))
    return feeds.frontier(found, known.where("seen % 10 = 0"), hosts, 3, 40)


RECORD = "URL: https://x.org/a\nTitle: A page\nStatus: 200\nimage: https://x.org/i.png\tAn image\nLink: https://x.org/b\nlink: https://x.org/c\npublished: 2024-01-02\n\nBody text\n\nmore"


@query("SELECT * FROM (VALUES ('https://x.org/a', 'A page', 'Body text' || chr(10) || chr(10) || 'more', 2::BIGINT, 'An image', 1704153600::BIGINT), ('https://x.org/z', 'https://x.org/z', 'only', 0, NULL, 0)) t(url, title, text, n_links, alt, published)")
def record_parser(spark, sf_dir):
    body = RECORD + "\n---\nno url: x\n\ndropped\n---\nurl: https://x.org/z\n\nonly"
    r = records.split_records(literal(spark, [(body,)], "body string"))
    return r.select("url", "title", "text", F.size("links").cast("long").alias("n_links"), F.get("images", F.lit(0))["alt"].alias("alt"), "published")


@query("SELECT * FROM (VALUES ('https://x.org/1', 'One', 'a \"b\" ☕', 0::BIGINT), ('https://x.org/2', 'https://x.org/2', '', 1704153600), ('https://x.org/3', 'Three', 't', 0)) t(url, title, text, published)")
def json_pages(spark, sf_dir):
    bodies = [('[{"url":"https://x.org/1","title":"One","text":"a \\"b\\" \\u2615","n":{"x":[1]}}, 5, {"url":"https://x.org/2","title":7,"published":"2024-01-02"}]',), ('{"url":"https://x.org/3","title":"Three","text":"t"}',), ("not json",)]
    return records.json_pages(literal(spark, bodies, "body string"))


@query("SELECT page_id, substr(sha256(url), 1, 16) || '.doc' AS name FROM pages")
def record_names(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", sinks.record_name(F.col("url")).alias("name"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'https://x.org/rust-logo.png'), (1, 'https://x.org/a.png'), (2, 'https://x.org/none.png')) t(i, url)")
def image_ranking(spark, sf_dir):
    images = [("https://x.org/none.png", ""), ("https://x.org/a.png", "A rust diagram"), ("https://x.org/rust-logo.png", "Rust logo")]
    d = literal(spark, [("rust logo -x site:y", "T", images)], "q string, title string, images array<struct<url:string,alt:string>>")
    ranked = shape.ranked_images(F.col("images"), shape.image_terms(F.col("q")), F.col("title"))
    return d.select(F.posexplode(ranked).alias("i", "x")).select(F.col("i").cast("long").alias("i"), "x.url")
