"""Page extraction with built-in expressions: title, readable text, date, links, images, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import urls

# Named entities of stored text; the crawler's set lacks the two guillemets.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™", "deg": "°"}
STORED_LIMIT, CRAWL_LIMIT = 10, 32
MAX_IMAGES = 24
LEAST_CONTENT = 80

# Elements that are no content, boilerplate containers, and the words of their attributes.
NO_CONTENT = "script style title noscript template svg canvas iframe".split()
CONTAINERS = "nav footer aside form select button".split()
NOISE_TAGS = "nav|footer|aside|header|section|div|ul"
NOISE_WORDS = "nav|navbar|menu|footer|sidebar|breadcrumb|cookie|consent|banner|advert|ads?|promo|subscribe|newsletter|modal|dialog|toolbar|pagination"
CONTENT_TAGS = "main|article|section|div"
CONTENT_WORDS = "content|article|entry|post|docs?|markdown|prose|body"
BLOCKS = "p|div|section|article|main|header|h[1-6]|li|ul|ol|pre|code|blockquote|table|tr|br"
PUBLISHED_METAS = r"article:published_time|datePublished|date|dc\.date|dc\.date\.issued|pubdate|sailthru\.date"
IMAGE_METAS = ["og:image", "og:image:url", "twitter:image", "twitter:image:src"]

VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s">]+))"""
HREF = rf"(?is)<a\b[^>]*\bhref{VALUE}"
NOISE = rf"""(?is)<(?:{NOISE_TAGS})\b[^>]*(?:id|class|role)\s*=\s*["'][^"']*(?:{NOISE_WORDS})[^"']*["'][^>]*>.*?</(?:{NOISE_TAGS})>"""
DROPPED = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in CONTAINERS)
CANDIDATES = [
    r"(?is)<main\b[^>]*>(.*?)</main>",
    r"(?is)<article\b[^>]*>(.*?)</article>",
    rf"""(?is)<(?:{CONTENT_TAGS})\b[^>]*\brole\s*=\s*["']main["'][^>]*>(.*?)</(?:{CONTENT_TAGS})>""",
    rf"""(?is)<(?:{CONTENT_TAGS})\b[^>]*(?:id|class)\s*=\s*["'][^"']*(?:{CONTENT_WORDS})[^"']*["'][^>]*>(.*?)</(?:{CONTENT_TAGS})>""",
]
PUBLISHED_TAG = rf"""(?is)<meta\b[^>]*\b(?:property|name|itemprop)\s*=\s*["'](?:{PUBLISHED_METAS})["'][^>]*>"""


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _some(text: Column) -> Column:
    """The text, null if it is empty."""
    return _let(text, lambda t: F.when(t != "", t))


def decode_entities(text: Column, limit: int = CRAWL_LIMIT) -> Column:
    """Named and numeric entities of at most ``limit`` characters as text; others stay as they are."""
    names = {k: v for k, v in ENTITIES.items() if limit <= STORED_LIMIT or k not in ("laquo", "raquo")}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    code = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(piece: Column) -> Column:
        body = F.regexp_extract(piece, rf"^([^;&]{{1,{limit}}});", 1)
        hexed, dec = F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]{1,7})$", 1), F.regexp_extract(body, "^#([0-9]{1,8})$", 1)
        char = F.when(hexed != "", code(F.conv(hexed, 16, 10).try_cast("bigint"))).when(dec != "", code(dec.try_cast("bigint"))).otherwise(F.try_element_at(table, body))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(body) + 2)), F.concat(F.lit("&"), piece))

    def decoded(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))

    return _let(text, lambda t: F.when(F.contains(t, F.lit("&")), _let(F.split(t, "&", -1), decoded)).otherwise(t))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<[^>]*>", " ")


def collapse(text: Column) -> Column:
    """Entities decoded, ASCII white space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(decode_entities(text), r"[\t\n\f\r ]+", " "), r"(?U)^\s+|\s+$", "")


def title(html: Column) -> Column:
    return collapse(strip_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))


def without_non_content(html: Column) -> Column:
    for tag in NO_CONTENT:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def without_boilerplate(html: Column) -> Column:
    for _ in range(2):
        html = F.regexp_replace(F.regexp_replace(html, NOISE, " "), DROPPED, " ")
    return html


def content_score(fragment: Column, text: Column) -> Column:
    """Words, headings and code count for a fragment, links against it."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return words + F.regexp_count(fragment, F.lit("(?i)<h[123]")) * 12 + F.regexp_count(fragment, F.lit("(?i)<(?:pre|code)")) * 8 - F.regexp_count(fragment, F.lit(HREF)) * 6


def best_content(html: Column) -> Column:
    """The fragment with the highest score, first on ties; the whole where none has enough text."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in CANDIDATES))
    texts = F.transform(found, lambda f, i: F.struct(collapse(strip_tags(without_boilerplate(f))).alias("text"), f.alias("f"), i.alias("i")))
    fit = F.filter(texts, lambda x: F.octet_length(x["text"]) >= LEAST_CONTENT)
    scored = F.transform(fit, lambda x: F.struct(content_score(x["f"], x["text"]).alias("score"), (-x["i"]).alias("first"), x["f"].alias("f")))
    return F.coalesce(F.array_max(scored)["f"], html)


def readable_text(html: Column) -> Column:
    best = best_content(without_non_content(html))
    return collapse(strip_tags(F.regexp_replace(without_boilerplate(best), rf"(?is)</?(?:{BLOCKS})\b[^>]*>", " ")))


def _first_group(text: Column, pattern: str) -> Column:
    """The first non-empty of three alternative captures; empty where nothing matches."""
    return F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def attribute(tag: Column, name: str) -> Column:
    return decode_entities(_first_group(tag, rf"(?is)\b{name}{VALUE}"))


def published(html: Column) -> Column:
    """The raw publish date: meta tag, then JSON-LD, then <time>; empty without one."""
    meta = F.trim(_first_group(F.regexp_extract(html, f"({PUBLISHED_TAG})", 1), rf"(?is)\bcontent{VALUE}"))
    linked = F.trim(F.regexp_extract(html, r'(?is)"datePublished"\s*:\s*"([^"]+)"', 1))
    timed = F.trim(F.regexp_extract(html, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']""", 1))
    return F.coalesce(_some(meta), _some(linked), timed)


def hrefs(html: Column) -> Column:
    captured = [F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3)]
    return F.zip_with(F.zip_with(captured[0], captured[1], lambda a, b: F.concat(a, b)), captured[2], lambda a, b: F.concat(a, b))


def links(url: Column, html: Column) -> Column:
    """Distinct absolute http(s) links without fragments, in order."""
    found = F.filter(hrefs(html), lambda h: (h != "") & ~h.startswith("#"))
    return F.array_distinct(F.filter(F.transform(found, lambda h: urls.resolve(url, h)), lambda u: u.isNotNull()))


def images(url: Column, html: Column, page_title: Column) -> Column:
    """array<struct<url, alt>>: social-card images, then <img>; distinct, MAX_IMAGES at most."""
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1)), lambda t: F.lower(F.coalesce(_some(attribute(t, "property")), attribute(t, "name"))).isin(IMAGE_METAS))
    first = lambda t, *names: F.coalesce(*(_some(attribute(t, n)) for n in names), F.lit(""))
    from_set = lambda t, name: _some(F.regexp_extract(F.trim(attribute(t, name)), r"^([^\s,]+)", 1))
    social = F.transform(metas, lambda t: F.struct(_let(_some(F.trim(attribute(t, "content"))), lambda u: urls.resolve(url, u)).alias("url"), page_title.alias("alt")))
    source = lambda t: F.coalesce(_some(first(t, r"(?<![\w-])src", "data-src", "data-original")), from_set(t, r"(?<![\w-])srcset"), from_set(t, "data-srcset"))
    shown = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), lambda t: F.struct(_let(F.trim(source(t)), lambda u: urls.resolve(url, u)).alias("url"), collapse(first(t, "alt", "title")).alias("alt")))
    found = F.filter(F.concat(social, shown), lambda x: x["url"].isNotNull() & (x["url"] != ""))

    def distinct(every: Column) -> Column:
        placed = F.transform(every, lambda x, i: F.struct(x.alias("x"), F.array_position(F.transform(every, lambda y: y["url"]), x["url"]).alias("p"), i.alias("i")))
        return F.slice(F.transform(F.filter(placed, lambda t: t["p"] == t["i"] + 1), lambda t: t["x"]), 1, MAX_IMAGES)

    return _let(found, distinct)


def local_title(html: Column, stem: Column) -> Column:
    """Title of a local file: the first <title>, else the file's stem."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), stem)


def local_text(html: Column) -> Column:
    """Text of a local file: no script, style, title or tags."""
    for tag in ("script", "style", "title"):
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(strip_tags(html), r"\s+", " "))


def extract(pages, url: str = "url", html: str = "html"):
    """A DataFrame of pages with title, text, published, links and images of each."""
    u, h = F.col(url), F.col(html)
    titled = pages.withColumn("title", title(h))
    return titled.withColumns({"text": readable_text(h), "published": published(h), "links": links(u, h), "images": images(u, h, F.col("title"))})
