"""Pages of HTML as columns: visible text, titles, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def visible_text(html: Column) -> Column:
    """Lines of text: scripts and styles dropped, line and block ends as line ends, tags dropped, blanks collapsed."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    x = F.regexp_replace(x, "(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article)>", "\n")
    x = decoded(F.regexp_replace(x, "<[^>]+>", " "))
    x = F.regexp_replace(x, "[ \t\r\f\u00a0]+", " ")
    return F.trim(F.regexp_replace(x, " ?\n[ \n]*", "\n"))


def title(html: Column) -> Column:
    """The first h1, else the title, without tags; '' without either."""
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " "))
    return decoded(F.coalesce(F.nullif(part("h1"), F.lit("")), part("title")))


def links(html: Column) -> Column:
    """Targets of anchors, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('(?i)<a[^>]*href="([^"]*)"'), F.lit(1))
