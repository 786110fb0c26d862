"""What a fetch says to its caller: completeness, renders worth their cost, hints, status, and the wire without what is plain."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftpage.functions.gate import unrendered_shell
from siftpage.functions.scalars import readiness

# The codes of hints, tiers that run scripts, what a render is for, words that ask and name nothing.
HINT_CODES = ("answer_truncated archive_snapshot_age browser_internal_error browser_unavailable captcha_redirect comments_partial content_empty content_guidance content_not_found content_thin cookies_stale default_vhost_page extraction_empty fetch_deadline_exceeded index_lost "
              "interaction_required listing_more listing_partial llm_error llm_unavailable paid_auth_error query_title_mismatch reddit_deleted_try_archive reddit_forbidden_try_archive report_feedback_available retrieval_incomplete section_unretrieved served_url_differs try_user_browser").split()  # fmt: skip
SCRIPTED = ["reader", "browser", "browser_robust"]
RENDERED_FOR, CEILING, SCROLL_MOST, PAID = ["empty", "blocked"], 2000, 300, 1
INCOMPLETE = ["wall", "gone_unverified", "thin_unverified", "empty_unverified"]
NUDGE = "report_feedback("
SENTENCE = f" If this doesn't answer what you needed, call {NUDGE}subject=..., note=...) to report it."


def listing_state(records: Column, oracle: Column, more: Column, read_total: Column) -> Column:
    """struct(loaded, total, more) of a listing; null where it is whole or none.

    A declared total beats a control that leads on; a total that a model read off the page counts only where the page's own
    was not found, and only adds.
    """
    s = lambda total, m: F.struct(records.alias("loaded"), total.cast("bigint").alias("total"), F.lit(m).alias("more"))
    short = lambda total: readiness(records, total) == "partial"
    own = F.when(short(oracle), s(oracle, False))
    read = F.when(read_total.isNotNull() & short(read_total), s(read_total, False))
    return F.when(records.isNull(), F.lit(None)).when(oracle.isNotNull(), own).otherwise(F.coalesce(read, F.when(more, s(F.lit(None), True))))


def wants_obstacle_render(asked: Column, obstacle: Column, paid: Column, tier: Column, content: Column, html: Column) -> Column:
    """A render may bring what the answer lacks: asked for, affordable, by a tier without scripts, thin, and a shell."""
    return F.coalesce(asked & obstacle.isin(RENDERED_FOR) & (paid < PAID) & ~tier.isin(SCRIPTED) & (F.length(content) < CEILING) & unrendered_shell(html), F.lit(False))


def wants_listing_render(enabled: Column, asked: Column, total: Column, paid: Column, tier: Column) -> Column:
    return F.coalesce(enabled & asked & total.isNotNull() & (paid < PAID) & ~tier.isin(SCRIPTED) & (total <= SCROLL_MOST), F.lit(False))


def nudged(hints: Column, confidence: Column) -> Column:
    """hints (code, fix, severity): the first warning or worse is given one more sentence; without any a low confidence gets a hint
    of its own. Done once, it is not done again."""
    loud = F.array_position(F.transform(hints, lambda h: h["severity"].isin("warning", "critical")), F.lit(True))
    done = F.exists(hints, lambda h: F.contains(F.coalesce(h["fix"], F.lit("")), F.lit(NUDGE)))
    told = F.transform(hints, lambda h, i: F.struct(h["code"].alias("code"), F.when(i + 1 == loud, F.concat(F.coalesce(h["fix"], F.lit("")), F.lit(SENTENCE))).otherwise(h["fix"]).alias("fix"), h["severity"].alias("severity")))
    own = F.struct(F.lit("report_feedback_available").alias("code"), F.lit(None).cast("string").alias("fix"), F.lit("info").alias("severity"))
    return F.when(done, hints).when(loud > 0, told).when(confidence == "low", F.array_append(hints, own)).otherwise(hints)


def index_lost(arm: Column, *lists: Column) -> Column:
    """The routing did not come through, and no list of what was withheld came by another way."""
    empty = F.lit(True)
    for x in lists:
        empty = empty & (F.coalesce(F.size(x), F.lit(0)) == 0)
    return arm.isin("unparsable", "unclassified") & empty


def status(verdict: Column, empty_confirmed: Column, small_promoted: Column, asked: Column, answer: Column, chars: Column, extracted: Column, grounded: Column, unavailable: Column, render_requested: Column, outcome: Column) -> Column:
    """struct(status, incomplete): an unretrieved page is never ok, and an ask without an answer has failed."""
    ok = (verdict == "ok") | empty_confirmed | small_promoted
    no_answer = extracted & (F.trim(F.coalesce(answer, F.lit(""))) == "") & ((chars > 500) | grounded)
    unanswered = (verdict == "ok") & asked & (no_answer | unavailable)
    failed = ~ok | unanswered
    incomplete = (verdict == "paid_auth_error") | unanswered | (failed & render_requested) | (failed & F.coalesce(outcome.isin(INCOMPLETE), F.lit(False)))
    return F.struct(F.when(failed, "failed").otherwise("ok").alias("status"), incomplete.alias("incomplete"))


def pruned(df: DataFrame, required: list[str], plain: dict[str, str], on_failure: list[str], debug: list[str]) -> Column:
    """The row as JSON without what is plain: required columns stay, empty ones and those at their plain value go, on_failure go
    where status is ok, debug columns move under `debug` while they hold anything."""
    kinds = dict(df.dtypes)

    def empty(n: str) -> Column:
        c = F.col(n)
        e = c.isNull()
        if kinds[n] == "string":
            e = e | (c == "")
        elif kinds[n].startswith(("array", "map")):
            e = e | (F.size(c) == 0)
        return e | (c == False) if n == "retrieval_incomplete" else e  # noqa: E712

    def kept(n: str) -> Column:
        c = F.col(n)
        if n in required:
            return c.alias(n)
        drop = empty(n)
        if n in plain:
            drop = drop | (c == plain[n])
        if n in on_failure:
            drop = drop | (F.col("status") == "ok")
        return F.when(~F.coalesce(drop, F.lit(True)), c).alias(n)

    inner = F.struct(*(F.when(~empty(n), F.col(n)).alias(n) for n in debug))
    has = F.lit(False)
    for n in debug:
        has = has | ~empty(n)
    return F.to_json(F.struct(*(kept(n) for n in df.columns if n not in debug), F.when(has, inner).alias("debug")))


@F.pandas_udf(ArrayType(StringType()))
def query_tokens(texts: pd.Series) -> pd.Series:
    """Words of three letters and digits or more, without marks and case; built-in functions have no such normal form."""
    import re

    def tokens(t: str | None) -> list[str]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", (t or "").casefold()) if not unicodedata.combining(c))
        return list(dict.fromkeys(x for x in re.split(r"[^a-z0-9]+", plain) if len(x) >= 3))

    return texts.map(tokens)


def off_target(query: Column, titles: Column, operators: list[str]) -> Column:
    """query and titles as tokens and arrays of tokens: the query names something, and no title has a word of it."""
    terms = F.array_except(query, F.array(*map(F.lit, operators)))
    return (F.size(terms) > 0) & (F.size(titles) > 0) & ~F.exists(titles, lambda t: F.arrays_overlap(t, terms))


def conditional(attempts: DataFrame, cached: DataFrame) -> DataFrame:
    """attempts (id, url, variant, status_code, conditional_hit, body) and the cache's rows -> (id, outcome, etag, last_modified, body).

    Validators are those of the row the cache has. An answer of 304 reuses that row's body; without a row it is unusable, and
    never content.
    """
    row = cached.select("url", "variant", "etag", "last_modified", F.col("body").alias("kept"), F.lit(True).alias("has"))
    both = attempts.join(row, ["url", "variant"], "left")
    hit = (F.col("status_code") == 304) & F.col("conditional_hit")
    outcome = F.when(~hit, "not_conditional").when(F.col("has"), "reused").otherwise("unusable")
    return both.select("id", outcome.alias("outcome"), "etag", "last_modified", F.when(~hit, F.col("body")).when(F.col("has"), F.col("kept")).alias("body"))


def merged_links(handler: DataFrame, mined: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, pos, url) three times -> (page_id, pos, url, via): a page's links are those of the first producer that has any."""
    every = handler.withColumn("rank", F.lit(0)).unionByName(mined.withColumn("rank", F.lit(1))).unionByName(listed.withColumn("rank", F.lit(2)))
    best = every.groupBy("page_id").agg(F.min("rank").alias("rank"))
    return every.join(best, ["page_id", "rank"]).select("page_id", "pos", "url", F.when(F.col("rank") == 0, "handler").when(F.col("rank") == 1, "mined").otherwise("listed").alias("via"))
