"""Addresses and links of web pages as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fieldloom.functions.text import strip

# Words looked for in a lower-cased address, by priority class.
HIGH_WORDS = [
    "team", "kontakt", "contact", "about", "ueber", "%c3%bcber",
    "menschen", "people", "staff", "mitarbeiter",
]
MEDIUM_WORDS = ["projekt", "project", "forschung", "research"]
LOW_WORDS = [
    "publikation", "publication", "veroeffentlichung", "paper",
    "service", "angebot", "offer",
]
EXCLUDED_WORDS = [
    "impressum", "imprint", "datenschutz", "privacy", "cookie",
    "login", "agb", "terms", "legal", "barrierefreiheit",
    "accessibility", "sitemap",
]
# Page type and its words; the first type with a hit wins.
PAGE_TYPES = [
    ("TEAM", ["team", "menschen", "people", "staff", "mitarbeiter", "about", "ueber", "%c3%bcber"]),
    ("CONTACT", ["kontakt", "contact"]),
    ("PUBLICATIONS", ["publikation", "publication", "veroeffentlichung", "paper"]),
    ("PROJECT", ["projekt", "project", "forschung", "research"]),
    ("SERVICE", ["service", "angebot", "offer", "tool"]),
]


def _has_word(col: Column, words: list[str]) -> Column:
    return F.lower(col).rlike("|".join(words))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def base_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; the value is computed once however often it is used, in filters too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_url(url: Column) -> Column:
    """Trim, default to https and require a host; NULL when that fails."""

    def checked(trimmed: Column, full: Column, name: Column) -> Column:
        usable = (F.length(trimmed) > 0) & (F.length(name) > 0) & (name.contains("[") == name.contains("]"))
        return F.when(usable, full)

    def completed(trimmed: Column) -> Column:
        full = F.when(trimmed.startswith("http://") | trimmed.startswith("https://"), trimmed).otherwise(
            F.concat(F.lit("https://"), trimmed)
        )
        return _once(full, lambda full: _once(host(full), lambda name: checked(trimmed, full, name)))

    return _once(strip(url), completed)


def _drop_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    cleaned = F.concat(F.lit("/"), F.array_join(kept, "/"))
    cleaned = F.when(cleaned == "/", cleaned).otherwise(F.concat(cleaned, closing))
    return F.when(path.rlike(r"/\.\.?(/|$)"), cleaned).otherwise(path)


def resolve_url(page: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on ``page``."""
    root = base_url(page)
    page_path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(page_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(path) + 1, F.length(href))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, _drop_dots(path), rest))
        .when(href.startswith("?"), F.concat(root, page_path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .otherwise(F.concat(root, _drop_dots(F.concat(folder, path)), rest))
    )


def page_title(html: Column) -> Column:
    """Trimmed text of the first title tag, '' without one."""
    text = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


_QUIET = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_HREF = r"(?is)<a(?=\s)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\shref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_VALUE = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))\z"


def hrefs(html: Column) -> Column:
    """Raw href values of anchor tags in document order; not those in comments, scripts and styles."""
    found = F.regexp_extract_all(F.regexp_replace(html, _QUIET, " "), F.lit(_HREF), F.lit(0))

    def value(tag):
        text = strip(F.concat(*[F.regexp_extract(tag, _VALUE, i) for i in (1, 2, 3)]))
        for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    return F.transform(found, value)


def page_links(url: Column, html: Column) -> Column:
    """Distinct same-host links of a page in document order, without fragments."""
    absolute = F.transform(F.filter(hrefs(html), lambda h: h != ""), lambda h: resolve_url(url, h))
    local = F.filter(absolute, lambda a: a.rlike(r"^https?://") & (host(a) == host(url)))
    plain = F.transform(local, lambda a: F.regexp_replace(a, "#.*$", ""))
    return F.array_distinct(F.filter(plain, lambda a: a != url))


def link_score(link: Column, page: Column) -> Column:
    """Worth of a link; anything that is not positive is not followed."""
    base = (
        F.when(_has_word(link, HIGH_WORDS), 10)
        .when(_has_word(link, MEDIUM_WORDS), 8)
        .when(_has_word(link, LOW_WORDS), 6)
        .otherwise(3)
    )
    excluded = F.when(_has_word(link, EXCLUDED_WORDS), 5).otherwise(0)
    foreign = F.when(host(link) != host(page), 10).otherwise(0)
    return base - excluded - foreign


def page_type(url: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, words in PAGE_TYPES:
        out = out.when(_has_word(url, words), F.lit(name))
    return out.otherwise(F.lit("OTHER"))


def site_url(prefix: Column, path: Column) -> Column:
    """Put ``prefix`` before ``path`` once, with a single slash."""
    keep = (prefix == "") | path.startswith(prefix)
    slash = F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(keep, path).otherwise(F.concat(prefix, slash, path))


def search_page(language: Column) -> Column:
    return F.when(language == "en", F.lit("search.html")).otherwise(F.lit("suche.html"))
