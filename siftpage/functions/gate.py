"""The page gate: is a captured body the page that was asked for?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def visible_text(html: Column) -> Column:
    """Text without script and style blocks and tags, white space collapsed."""
    html = F.regexp_replace(F.regexp_replace(html, P.CODE_BLOCK, " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(html, r"\s+", " "))


#: (condition of md, html, content type and whether md is short; verdict; subsystem; next tier), the first that holds decides.
def _ladder(md: Column, html: Column, kind: Column, short: Column):
    yield (F.coalesce(kind, F.lit("")) != "") & ~F.lower(kind).contains("html"), "content_type_mismatch", None, None
    yield html.rlike(P.TURNSTILE), "anti_bot", "turnstile", "browser"
    yield html.rlike(P.AKAMAI), "anti_bot", "akamai_bmp", "browser"
    yield short & html.rlike(P.ANUBIS), "anti_bot", "anubis", "browser"
    yield html.rlike(P.REDDIT), "block_page_detected", "reddit_interstitial", None
    yield html.rlike(P.BAXIA), "anti_bot", "alibaba_punish", "browser"
    yield html.rlike(P.CAPTCHA), "block_page_detected", "captcha_redirect", None
    yield html.rlike(P.VHOST), "block_page_detected", "default_vhost_page", None
    yield short & html.rlike(P.CF), "block_page_detected", "cf_iuam", "tls_impersonate"
    yield short & html.rlike(P.BLOCK), "block_page_detected", None, None
    yield short & html.rlike(P.SCRIPT) & html.rlike(P.SHELL), "length_floor", "js_required", "browser"
    yield short & (F.length(visible_text(html)) < P.BLANK) & ~html.rlike(P.LD_JSON), "blank_page", None, "browser"
    yield short & (md.rlike(P.EMPTY) | html.rlike(P.EMPTY)), "length_floor", "empty_result", None
    yield short, "length_floor", "thin_fallthrough", None


def _outcome(verdict: str, subsystem: str | None, tier: str | None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(subsystem).cast("string").alias("subsystem"), F.lit(tier).cast("string").alias("next_tier"))


def gate(md: Column, html: Column, kind: Column) -> Column:
    """struct(verdict, subsystem, next_tier); null bodies count as empty. md is bound once, however often a rung reads it."""
    page = F.struct(F.coalesce(md, F.lit("")).alias("md"), F.coalesce(html, F.lit("")).alias("html"), kind.alias("kind"))

    def judge(p: Column) -> Column:
        rungs = _ladder(p["md"], p["html"], p["kind"], F.length(p["md"]) < P.LENGTH_FLOOR)
        return F.coalesce(*(F.when(c, _outcome(*r)) for c, *r in rungs), _outcome("ok", None, None))

    return F.get(F.transform(F.array(page), judge), F.lit(0))


def overlaid(found: Column, md: Column, tier: Column, host: Column, is_json: Column, structured: Column, js_heavy: list[str]) -> Column:
    """The gate's struct with what is known of the fetch laid over it, and promoted.

    A thin page of a browser from a host that lives by scripts is under the floor; short JSON is a whole answer; a structured
    answer lifts a bare length_floor, and a marker of Akamai or Turnstile on a page that is long enough.
    """
    out = lambda v, s, t, p: F.struct(v.alias("verdict"), s.alias("subsystem"), t.alias("next_tier"), F.lit(p).alias("promoted"))
    none, ok = F.lit(None).cast("string"), F.lit("ok")
    named = F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", "").isin(*js_heavy), F.lit(False))
    thin = F.coalesce(tier == "browser", F.lit(False)) & (F.length(md) < P.THIN_BROWSER) & named & found["verdict"].isin("ok", "length_floor")
    one = F.struct(F.when(thin, "length_floor").otherwise(found["verdict"]).alias("verdict"), F.when(thin, "thin_browser_response").otherwise(found["subsystem"]).alias("subsystem"), found["next_tier"].alias("next_tier"))

    def lay(g: Column) -> Column:
        json = is_json & g["verdict"].isin("length_floor", "blank_page")
        bare = structured & (g["verdict"] == "length_floor") & F.coalesce(g["subsystem"] == "thin_fallthrough", F.lit(True))
        marked = structured & (g["verdict"] == "anti_bot") & F.coalesce(g["subsystem"].isin("akamai_bmp", "turnstile"), F.lit(False)) & (F.length(md) >= P.LENGTH_FLOOR)
        return F.when(json, out(ok, none, none, False)).when(bare, out(ok, none, g["next_tier"], True)).when(marked, out(ok, none, none, True)).otherwise(out(g["verdict"], g["subsystem"], g["next_tier"], False))

    return F.get(F.transform(F.array(one), lay), F.lit(0))


def regate(md: Column) -> Column:
    """The gate over what an escalation has rendered: its text is judged as body and as page, of no content type."""
    return gate(md, md, F.lit(None).cast("string"))


def challenge(md: Column, html: Column) -> Column:
    """The verdict and subsystem of a page that is a challenge; null for any other."""
    g = gate(md, html, F.lit(None).cast("string"))
    return F.when(g["verdict"].isin("anti_bot", "block_page_detected"), F.struct(g["verdict"].alias("verdict"), g["subsystem"].alias("subsystem")))


def unrendered_shell(html: Column) -> Column:
    """A page of scripts with a place to mount an app."""
    return html.rlike(P.SCRIPT) & html.rlike(P.SPA_MOUNT)
