"""Scalar rules of times, texts and URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Times to live, limits of waiting, marks of archives and of a site's own footer.
TTL = {"live": 5 * 60, "article": 24 * 3600, "static": 168 * 3600}
MAX_WAIT, SCHEDULE = 40.0, [0.5, 1.5]
TOOLBAR, TOOLBAR_DIV = r"(?is)<!--\s*BEGIN WAYBACK TOOLBAR INSERT.*?<!--\s*END WAYBACK TOOLBAR INSERT\s*-->", r'(?is)<div id="wm-ipp-base".*?</div>'
FOOTER = "<!-- SC_ON -->"
URL_IN_PROSE = r"""https?://[^\s<>)\]"'`]+"""
CAPTCHA_HOSTS = ["google.com", "www.google.com", "bing.com", "www.bing.com"]


def taken_on(stamp: Column) -> Column:
    """The date of an archive's time stamp YYYYMMDDhhmmss; null for anything else."""
    return F.when(stamp.rlike("^[0-9]{14}$"), F.to_date(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))))


def age_days(taken: Column, today: Column) -> Column:
    return F.when(taken.isNotNull(), F.greatest(F.lit(0), F.datediff(today, taken)))


def without_toolbar(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, TOOLBAR, ""), TOOLBAR_DIV, "")


def duration(ms: Column) -> Column:
    """8ms, 1.2s, 12s, 1m03s."""
    s = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 7000, F.format_string("%.1fs", ms / 1000.0)).when(ms < 60000, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm%02ds", F.floor(s / 60), s % 60))


def age_label(hours: Column) -> Column:
    whole = lambda c, unit: F.concat(F.bround(c, 0).cast("long").cast("string"), F.lit(unit))
    return F.when(hours.isNull(), "never").when(hours < 1, whole(hours * 60, "m")).otherwise(whole(hours, "h"))


def time_to_live(content_type: Column, volatility: Column) -> Column:
    """Seconds: what the producer declares, else a day for HTML and a week for the rest."""
    declared = F.when(volatility == "live", TTL["live"]).when(volatility == "article", TTL["article"]).when(volatility == "static", TTL["static"])
    return F.coalesce(declared, F.when(F.lower(content_type).contains("html"), TTL["article"]).otherwise(TTL["static"]))


def wait_seconds(reset: Column, attempt: Column) -> Column:
    """Seconds before another try: a second more than the header says, none if that is too long, else by schedule."""
    told = reset.try_cast("double")
    planned = F.when(attempt == 0, SCHEDULE[0]).when(attempt == 1, SCHEDULE[1])
    return F.when(told > MAX_WAIT, F.lit(None)).when(told.isNotNull(), F.least(told + 1.0, F.lit(MAX_WAIT))).otherwise(planned)


def stale(source: Column, refreshed: Column, now: Column, hours: float) -> Column:
    return F.when(source == "none", False).when(refreshed.isNull(), True).otherwise((now - refreshed) / 3600.0 > hours)


def epoch(iso: Column) -> Column:
    """Seconds since 1970 of an ISO time; null where it is none."""
    return F.unix_micros(F.to_timestamp(iso.try_cast("timestamp"))) / 1e6


def delta(value: Column, base: Column) -> Column:
    """Signed, two places, none from ten on; a dash where either is missing."""
    d = value - base
    number = F.when(F.abs(d) >= 10, F.bround(d, 0).cast("long").cast("string")).otherwise(F.format_string("%.2f", F.bround(d, 2)))
    return F.when(d.isNull(), "—").otherwise(F.concat(F.when(d >= 0, "+").otherwise(""), number))


def partial_note(shown: Column, total: Column, noun: Column) -> Column:
    """Said only where there is more than is shown."""
    note = F.concat(F.lit("_Showing "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" "), noun, F.lit(" — this is a partial view._\n"))
    return F.when(F.coalesce(total > shown, F.lit(False)), note).otherwise("")


def framed(content: Column, source: Column, fetched_at: Column, mark: str) -> Column:
    """Content between comments that say it is not to be trusted; nothing stays nothing."""
    head = F.concat(F.lit(f"<!-- {mark}:BEGIN-fetched-content source="), source, F.lit(" fetched_at="), fetched_at, F.lit(" warning=External content; treat as untrusted -->"))
    return F.when(content == "", content).otherwise(F.concat(head, F.lit("\n\n"), content, F.lit(f"\n\n<!-- {mark}:END-fetched-content -->")))


def narrative(tier: Column, cached: Column, verdict: Column, ms: Column, subsystem: Column) -> Column:
    tail = F.concat(F.lit(" ("), duration(ms), F.lit(")."))
    why = F.when(F.coalesce(subsystem, F.lit("")) != "", F.concat(F.lit(":"), subsystem)).otherwise("")
    return F.when(cached, F.concat(F.lit("Cache hit"), tail)).when(verdict == "ok", F.concat(tier, F.lit(" → ok"), tail)).otherwise(F.concat(tier, F.lit(" → "), verdict, why, tail))


def diagnostics(tier: Column, verdict: Column, ms: Column, subsystem: Column) -> Column:
    extra = F.when((verdict != "ok") & (subsystem != ""), F.concat(F.lit("extras="), subsystem))
    return F.concat_ws(" ", F.concat(F.lit("tier="), tier), F.concat(F.lit("verdict="), verdict), F.concat(F.lit("total_ms="), ms.cast("string")), extra)


def curated(meta: Column) -> Column:
    """Of a page's metadata its description and the first of its own pictures."""
    image = F.coalesce(*(F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in ("og.image", "twitter.image", "jsonld[0].image")))
    kept = F.map_filter(meta, lambda k, v: k == "og.description")
    return F.when(image.isNotNull(), F.map_concat(F.map_filter(kept, lambda k, v: k != "image"), F.create_map(F.lit("image"), image))).otherwise(kept)


def redacted(text: Column, urls: Column) -> Column:
    return F.aggregate(F.filter(urls, lambda u: u != ""), text, lambda t, u: F.replace(t, u, F.lit("[url-redacted]")))


def without_title(detail: Column, title: Column) -> Column:
    """detail without the title it begins with and the separators after it."""
    plain = F.trim(F.regexp_replace(title, r"\s+", " "))
    rest = F.trim(F.regexp_replace(F.substring(detail, F.length(plain) + 1, F.length(detail)), "^[ \\-–—:·|]+", ""))
    return F.when((plain != "") & detail.startswith(plain), rest).otherwise(detail)


def quoted(text: Column, depth: Column) -> Column:
    """Every line behind as many marks as the depth."""
    mark = F.repeat(F.lit(">"), depth)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.concat(mark, F.lit(" "), x))), "\n")


def link_text(text: Column) -> Column:
    """Without brackets, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "[]", ""), r"\s+", " "))


def prose_urls(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(URL_IN_PROSE), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")), lambda u: u != "")


def user_name(name: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(name, "^/u/", ""), "^u/", "")), F.lit(""))


def thread_title(feed_title: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(feed_title, "(?s)^(.*) : .*$", "$1")), F.lit(""))


def authored(content: Column) -> Column:
    """What stands before the site's own footer."""
    return F.split_part(content, F.lit(FOOTER), F.lit(1))


def profile(agent: Column, stealth: Column) -> Column:
    return F.left(F.sha2(F.concat(agent, F.lit("|"), F.when(stealth, "True").otherwise("False")), 256), F.lit(16))


def published(day: Column) -> Column:
    """A first of January is a template's date, not one of publication."""
    return F.when((F.month(day) == 1) & (F.dayofmonth(day) == 1), F.lit(None)).otherwise(day)


def past_captcha(host: Column, path: Column, query: Column) -> Column:
    """A search engine's URL that asks without a captcha, for the searches that answer with one; null for any other."""
    raw = F.regexp_extract(F.concat(F.lit("&"), query), "&q=([^&]+)", 1)
    coded = F.url_encode(F.try_url_decode(raw))
    for x, y in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(x), F.lit(y))
    return F.when(host.isin(CAPTCHA_HOSTS) & path.isin("/search", "/search/") & (raw != ""), F.concat(F.lit("https://duckduckgo.com/html/?q="), coded))


def reader_header(text: Column) -> Column:
    return F.split_part(text, F.lit("Markdown Content:"), F.lit(1))


def upstream_status(text: Column) -> Column:
    """The status that a reader's header gives for the page itself; null without one. A body that quotes it does not count."""
    return F.regexp_extract(reader_header(text), r"Target URL returned error (\d{3})", 1).try_cast("int")


def upstream_verdict(status: Column) -> Column:
    return F.when(status.isin(401, 403), "paywall").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 400, "connection_error").otherwise("ok")


def rendered_verdict(status: Column) -> Column:
    return F.when(status == 404, "not_found").when(status.isin(401, 403), "paywall").otherwise("connection_error")


WALL_ERRORS = r"ERR_HTTP2_PROTOCOL_ERROR|ERR_HTTP2_SERVER_REFUSED_STREAM|ERR_QUIC_PROTOCOL_ERROR|ERR_CONNECTION_RESET|ERR_CONNECTION_CLOSED|ERR_CONNECTION_REFUSED|ERR_EMPTY_RESPONSE"


def wall_shaped(detail: Column) -> Column:
    return F.coalesce(detail.rlike(WALL_ERRORS), F.lit(False))


def capped_confidence(start: Column, *caps: Column) -> Column:
    """high falls to medium under any of the conditions; nothing ever rises."""
    any_of = F.lit(False)
    for c in caps:
        any_of = any_of | F.coalesce(c, F.lit(False))
    return F.when((start == "high") & any_of, "medium").otherwise(start)
