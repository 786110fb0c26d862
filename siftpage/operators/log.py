"""Decision logs, health and caches: keyed state as batch aggregates and windows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.patterns import VERDICT_RANK


def rank(verdict: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(VERDICT_RANK.items())))[verdict]


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def _resolution() -> dict[str, Column]:
    """Aggregates that resolve a log, in any order of its rows and however often they come."""
    gate, tier, ok = F.col("kind") == "gate_outcome", F.col("kind") == "tier_outcome", F.col("verdict") == "ok"
    weight = F.struct(F.col("authoritative").cast("int").alias("a"), rank(F.col("verdict")).alias("r"), F.col("verdict").alias("v"))
    best = lambda on: F.max(F.when(on | F.col("authoritative"), weight))["v"]
    return {"gate_ok": _any(gate & ok), "tier_ok": _any(tier & ok), "gated": _any(gate), "by_gate": best(gate), "by_tier": best(tier & ~ok), "observations": F.count(F.lit(1))}


def _resolved() -> Column:
    """A gate that says ok wins; a tier's ok without any gate is ok. Else the authoritative, then the highest-ranking verdict
    wins: of gates and authoritative observations if a tier won, of failed tiers and authoritative ones if none did."""
    verdict = F.when(F.col("gate_ok") | (F.col("tier_ok") & ~F.col("gated")), "ok").when(F.col("tier_ok"), F.col("by_gate")).otherwise(F.col("by_tier"))
    return F.coalesce(verdict, F.lit("other"))


def resolve_verdicts(log: DataFrame) -> DataFrame:
    """log (fetch_id, kind, verdict, authoritative) -> (fetch_id, verdict, observations)."""
    found = log.groupBy("fetch_id").agg(*(c.alias(n) for n, c in _resolution().items()))
    return found.select("fetch_id", _resolved().alias("verdict"), "observations")


def failure_runs(events: DataFrame, threshold: int) -> DataFrame:
    """events (key, seq, failed) -> (key, longest_run, opened): runs of failures in a row; opened counts those that reach the threshold."""
    w = Window.partitionBy("key").orderBy("seq")
    runs = events.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w)).where("failed").groupBy("key", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("key").agg(F.max("n").alias("longest_run"), F.count_if(F.col("n") >= threshold).alias("opened"))


def first_visit_after(suggested: DataFrame, visits: DataFrame) -> DataFrame:
    """suggested (id, target, ts) and visits (target, ts) -> (id, target, ts, followed_at): the first later visit of the target.

    Both sides go through one window by target, so a target's suggestions never meet all of its visits. A suggestion at the
    time of a visit is not followed by it.
    """
    both = suggested.select("id", "target", "ts", F.lit(None).cast(visits.schema["ts"].dataType).alias("visit")).unionByName(visits.select("target", "ts", F.col("ts").alias("visit")), allowMissingColumns=True)
    later = Window.partitionBy("target").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    both = both.withColumn("next", F.min("visit").over(later))
    return both.where("id is not null").select("id", "target", "ts", F.col("next").alias("followed_at"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """events (key, ts) -> (key, started, n): bursts parted by more than the gap."""
    return events.groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("started"), "n")


# Gate verdicts that are walls, marks of a page that is not just small, statuses of a challenge.
HARD_WALLS = ["block_page_detected", "anti_bot", "paywall", "blank_page"]
SHELLS = ["js_required", "thin_browser_response", "empty_result"]
CHALLENGES = [401, 403, 429]
GONE_AGREED = 2  # observations of not_found that agree


def log_facts(log: DataFrame) -> DataFrame:
    """log (fetch_id, seq, kind, source, verdict, subsystem, next_tier, authoritative, status_code, cloudflare, blocks) -> one
    row per fetch with its resolved verdict, its last observation and all evidence that rules ask for, by one aggregate."""
    gate, tier, gone = F.col("kind") == "gate_outcome", F.col("kind") == "tier_outcome", F.col("verdict") == "not_found"
    regate = gate & (F.col("source") == "regate")
    facts = _resolution() | {
        "last": F.max(F.struct("seq", "kind", "verdict", "subsystem", "next_tier", "authoritative", "status_code", "cloudflare")),
        "last_gate": F.max(F.when(gate, F.struct("seq", "verdict")))["verdict"],
        "gone_said": _any(F.col("authoritative") & gone),
        "gone_seen": F.count_if(tier & gone),
        "hard_wall": _any(gate & F.col("verdict").isin(HARD_WALLS)),
        "shell": _any(gate & F.col("subsystem").isin(SHELLS)),
        "blocked": _any(F.col("blocks") > 0),
        "marked_empty": _any(gate & (F.col("subsystem") == "empty_result")),
        "js_required": _any(F.col("subsystem") == "js_required"),
        "challenged": _any(F.col("status_code").isin(CHALLENGES)),
        "read_empty": _any(regate & (F.col("subsystem") == "empty_result")),
        "read_thin": _any(regate & (F.col("verdict") == "length_floor") & (F.col("subsystem") == "thin_fallthrough")),
    }
    return log.groupBy("fetch_id").agg(*(c.alias(n) for n, c in facts.items())).withColumn("verdict", _resolved())


def outcome() -> Column:
    """Why a fetch failed, over log_facts: null for one that did not.

    An error of the operator stands first, then unreachable, an authoritative "gone", evidence of a wall anywhere in the log,
    agreeing or lone not_found of tiers, a last gate that found the page thin (with or without a mark of an empty result), else
    a wall.
    """
    c = F.col
    out = F.when(c("verdict") == "ok", F.lit(None)).when(c("verdict") == "paid_auth_error", "operator_error").when(c("verdict").isin("dns_error", "content_type_mismatch"), "unreachable").when(c("gone_said"), "gone_confirmed")
    out = out.when(c("blocked") | c("hard_wall"), "wall").when(c("gone_seen") >= GONE_AGREED, "gone_confirmed").when(c("gone_seen") > 0, "gone_unverified")
    return out.when(c("last_gate") == "length_floor", F.when(c("marked_empty"), "empty_unverified").otherwise("thin_unverified")).otherwise("wall")


def classify_terminal(log: DataFrame) -> DataFrame:
    """(fetch_id, verdict, outcome) of every failed fetch."""
    return log_facts(log).where("verdict <> 'ok'").select("fetch_id", "verdict", outcome().alias("outcome"))


def promotion(url: Column) -> Column:
    """empty or small for a thin page that is safe to take as whole, over log_facts; null for any other.

    Neither may show a wall, a challenged subresource or a challenge status, and a tier must have won. Empty: the browser too
    read an empty result, and the URL is that of a search. Small: no mark of a shell, and the browser too read it as thin.
    """
    from siftpage.operators.links import search_shaped

    c = F.col
    clear = ~c("hard_wall") & ~c("blocked") & ~c("challenged") & c("tier_ok")
    return F.when(clear & c("read_empty") & F.coalesce(search_shaped(url), F.lit(False)), "empty").when(clear & ~c("shell") & c("read_thin"), "small")
