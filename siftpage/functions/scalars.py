"""Scalar rules of fetching and answering, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions.patterns import LENGTH_FLOOR

# Fixed values.
READER_PREFIXES = ["https://r.jina.ai/", "http://r.jina.ai/", "r.jina.ai/"]
ITEMS = r'(?i)"?numberOfItems"?\s*[:=]\s*"?([0-9][0-9.,]*)"?'
SHOWN = r"(?i)([0-9][0-9.,]*)\s*(?:results?|sonuç|sonuc|ürün|urun|adet|products?|items?|listings?|entries|entry)\b"
LABEL_COUNT = r"^(.*\S)\s+\(?([0-9]+)\)?$"
JSON_TYPE = r"(?i)^(application|text)/([^;]*\+)?json"
MINUTE, HOUR, DAY, YEAR = 60, 3600, 86400, 86400 * 365
DETAIL_FLOOR, DETAIL_CAP, SHELF_BUDGET = 60, 240, 4000
HIGH_CHARS, TOLERANCE = 2000, 0.9


def raw_verdict(status: Column, content_type: Column) -> Column:
    """A direct answer's verdict: HTML and JSON are content, anything else is a mismatch."""
    kind = F.when(content_type.rlike(JSON_TYPE) | F.lower(content_type).contains("html"), "ok").otherwise("content_type_mismatch")
    return F.when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 400, "connection_error").otherwise(kind)


def paid_verdict(status: Column) -> Column:
    """A paid service's verdict: refused keys and unpaid bills are errors of the operator."""
    return F.when(status.isin(401, 402, 403), "paid_auth_error").when(status == 429, "rate_limited").when(status == 404, "not_found").when(status >= 400, "connection_error").otherwise("ok")


def human_age(seconds: Column) -> Column:
    """Whole seconds, minutes, hours, days or years, whichever is the largest that fits; negative ages are 0s."""
    s = F.greatest(seconds, F.lit(0))
    steps = [(MINUTE, 1, "s"), (HOUR, MINUTE, "m"), (DAY, HOUR, "h"), (YEAR, DAY, "d")]
    out = F.concat(F.floor(s / YEAR).cast("string"), F.lit("y"))
    for below, unit, mark in reversed(steps):
        out = F.when(s < below, F.concat(F.floor(s / unit).cast("string"), F.lit(mark))).otherwise(out)
    return out


def confidence(verdict: Column, body: Column) -> Column:
    return F.when(verdict != "ok", "low").when(F.length(body) > HIGH_CHARS, "high").otherwise("medium")


def readiness(loaded: Column, total: Column, tolerance: float = TOLERANCE) -> Column:
    """What was loaded against what the page declares; no declaration is ready."""
    return F.when(total.isNull(), "ready").when((total > 0) & (loaded == 0), "fail").when(loaded >= total * F.lit(tolerance), "ready").otherwise("partial")


def counted(digits: Column) -> Column:
    """A written count without its separators; null where no number is left."""
    return F.regexp_replace(digits, "[.,]", "").try_cast("bigint")


def listing_total(html: Column) -> Column:
    """The declared number of items, else the largest count in front of a noun for items."""
    return F.coalesce(counted(F.regexp_extract(html, ITEMS, 1)), F.array_max(F.transform(F.regexp_extract_all(html, F.lit(SHOWN), F.lit(1)), counted)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def capped(text: Column, cap: Column) -> Column:
    """At most cap characters, the last an ellipsis where some were cut."""
    return F.when(F.length(text) > cap, F.concat(F.rtrim(F.left(text, cap - 1)), F.lit("…"))).otherwise(text)


def detail_cap(options: Column) -> Column:
    """Characters for each of so many options that keep the shelf in its budget."""
    return F.greatest(F.lit(DETAIL_FLOOR), F.least(F.lit(DETAIL_CAP), F.floor(F.lit(SHELF_BUDGET) / options))).cast("int")


def truncated(text: Column, cap: int) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit(f"\n\n[Content truncated to {cap} chars]\n"))).otherwise(text)


def unwrapped(url: Column) -> Column:
    """The URL that a reader's URL wraps; null for any other."""
    out = F.lit(None).cast("string")
    for p in reversed(READER_PREFIXES):
        inner = F.substring(url, F.lit(len(p) + 1), F.length(url))
        out = F.when(url.startswith(p), F.when(inner.rlike("^https?://"), inner)).otherwise(out)
    return out


def read_flags(rendered: Column, verdict: Column, chars: Column) -> tuple[Column, Column]:
    """Whether a rendered page was read, with enough text and a clean verdict, and whether it got past the walls at all."""
    return rendered & (verdict == "ok") & (chars >= LENGTH_FLOOR), rendered & ~verdict.isin("anti_bot", "block_page_detected")


def read_again(body: Column, content_type: Column) -> Column:
    """Whether what an escalation brought is markup to be read once more: text that is Markdown or JSON already is not."""
    return (F.coalesce(F.length(body), F.lit(0)) > 0) & F.contains(F.coalesce(content_type, F.lit("")), F.lit("html"))
