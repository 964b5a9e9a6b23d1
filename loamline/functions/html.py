"""Text, links, metadata and signals of HTML pages as column expressions over their markup.

These read markup by patterns, in one pass inside the JVM; what needs the
element tree (selectors, ancestors, nested lists) is in ``operators.trees``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
CHROME = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("nav", "header", "footer", "aside", "script", "style", "noscript"))
CHROME = "(?is)" + CHROME
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""

# Character references that are decoded by column expressions.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®",
    "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&",
}


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def unescaped(text: Column) -> Column:
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def visible_text(html: Column) -> Column:
    """Text outside scripts and styles, tags as spaces, white space collapsed."""
    return collapsed(F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), "<[^>]*>", " "))


def plain_text(html: Column) -> Column:
    """Visible text with its character references decoded."""
    return collapsed(unescaped(visible_text(html)))


def text_without_chrome(html: Column) -> Column:
    return collapsed(F.regexp_replace(F.regexp_replace(html, CHROME, " "), "<[^>]*>", " "))


def title(html: Column) -> Column:
    return collapsed(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']([^"']*)["']""", 1))


def meta(html: Column, name: str) -> Column:
    """Content of the first meta tag of that name or property, '' if none."""
    return unescaped(
        F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*["']{name}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    )


def anchors(html: Column) -> Column:
    """array<struct<href,label>> of the anchors in page order."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    clean = F.transform(labels, lambda x: plain_text(x))
    return F.arrays_zip(F.transform(hrefs, unescaped).alias("href"), clean.alias("label"))


def images(html: Column) -> Column:
    """Distinct image sources in page order, a deferred source standing in for a missing one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1))

    def source(t: Column) -> Column:
        own = F.regexp_extract(t, r"""(?i)(?:^|\s)src\s*=\s*["']([^"']*)["']""", 1)
        later = F.regexp_extract(t, r"""(?i)\bdata-src\s*=\s*["']([^"']*)["']""", 1)
        return F.when(own != "", own).otherwise(later)

    return F.slice(F.array_distinct(F.filter(F.transform(tags, source), lambda x: x != "")), 1, 20)


def source_set(value: Column) -> Column:
    """Addresses of a comma-separated source set, without their sizes."""
    return F.transform(F.split(value, r",\s+"), lambda x: F.regexp_extract(F.trim(x), r"^(\S*)", 1))


def list_items(html: Column) -> Column:
    """Item texts of the un-nested lists with three items or more, ten lists and thirty items at most."""
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<[uo]l\b[^>]*>(.*?)</[uo]l>"), F.lit(1))
    items = F.transform(lists, lambda x: F.slice(F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), plain_text), 1, 30))
    return F.slice(F.filter(items, lambda x: F.size(x) >= 3), 1, 10)
