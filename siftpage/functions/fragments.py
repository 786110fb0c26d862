"""Fragments of markup as text and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that named references stand for; numbered ones of those are read too.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&nbsp;", " "), ("&#160;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def fragment_text(html: Column) -> Column:
    """A fragment of markup as one line of text."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def fragment_markdown(html: Column) -> Column:
    """A fragment of markup as Markdown: paragraphs, breaks, links, emphasis, code, lists, headings and quotes; other tags go."""
    rules = [
        (r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"[ \t]+\n", "\n"),
        (r"(?is)<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code\s*>)?\s*</pre\s*>", "\n\n```\n$1\n```\n\n"),
        (r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", "[$2]($1)"), (r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>", "**$1**"), (r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)\s*>", "*$1*"), (r"(?is)<code\b[^>]*>(.*?)</code\s*>", "`$1`"),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), *((rf"(?i)<h{k}\b[^>]*>", "\n\n" + "#" * k + " ") for k in range(1, 7)), (r"(?i)<blockquote\b[^>]*>\s*(?:<p\b[^>]*>)?", "\n\n> "), (r"(?i)</?(?:p|div|ul|ol|blockquote|table|tr|h[1-6])\b[^>]*>", "\n\n"), (r"<[^>]*>", ""),
        (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ]
    for pattern, by in rules:
        html = F.regexp_replace(html, pattern, by)
    return unescaped(F.regexp_replace(html, r"^\s+|\s+$", ""))
