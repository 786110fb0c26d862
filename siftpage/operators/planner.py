"""What to try next for a fetch, from its decision log: ordered rules over one row of facts a fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.operators.log import HARD_WALLS, log_facts, outcome, promotion

# How often a fetch may do each, shapes of URLs that have rules of their own.
REWRITES, ARCHIVES, BROWSERS, PAID = 1, 1, 2, 1
ARXIV_PDF = r"(?i)^https?://arxiv\.org/pdf/([^/?#]+?)(?:\.pdf)?(?:[/?#].*)?$"
REDDIT_COMMENT = r"(?i)^https?://(?:www\.|old\.|np\.)?reddit\.com/r/[^/]+/comments/"
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4

def rules() -> list[tuple[str, int, Column, str]]:
    """(name, priority, condition, action) in order of declaration; conditions read log_facts and the request's columns."""
    c, last = F.col, lambda n: F.col(f"last.{n}")
    tier, gate = last("kind") == "tier_outcome", last("kind") == "gate_outcome"
    verdict, status = last("verdict"), last("status_code")
    archive = c("archive_dispatches") < ARCHIVES
    failed = tier & (c("browser_dispatches") < BROWSERS)
    refused = failed & (verdict == "connection_error")
    bare = (verdict == "length_floor") & (last("subsystem") == "thin_fallthrough") & ~c("shell") & ~c("hard_wall")
    paid = verdict.isin(HARD_WALLS) | ((verdict == "length_floor") & (last("subsystem") == "js_required"))
    return [
        ("arxiv_pdf_rewrite", CRITICAL, c("url").rlike(ARXIV_PDF) & (c("url_rewrites") < REWRITES), "rewrite_url"),
        ("gate_browser_signal", HIGH, gate & (last("next_tier") == "browser") & (verdict != "ok") & (c("browser_dispatches") < BROWSERS), "escalate_browser"),
        ("reddit_comment_not_found_archive", MEDIUM, tier & (verdict == "not_found") & (last("authoritative") | (status == 404)) & c("url").rlike(REDDIT_COMMENT) & archive & ~c("js_required"), "retry_via_archive"),
        ("cloudflare_403_429_archive", LOW, tier & last("cloudflare") & status.isin(403, 429) & archive, "retry_via_archive"),
        ("paywall_or_block_archive", LOW, verdict.isin("paywall", "block_page_detected") & archive, "retry_via_archive"),
        ("forbidden_403_escalate", LOW, refused & (status == 403), "escalate_browser"),
        ("server_5xx_escalate", LOW, refused & (status >= 500), "escalate_browser"),
        ("other_4xx_escalate", LOW, refused & status.between(400, 499) & (status != 403), "escalate_browser"),
        ("timeout_escalate", LOW, failed & (verdict == "timeout"), "escalate_browser"),
        ("network_drop_escalate", LOW, refused & (status == 0), "escalate_browser"),
        ("uncorroborated_404_escalate", LOW, failed & (verdict == "not_found") & ~last("authoritative"), "escalate_browser"),
        ("exhausted_429_escalate", LOW, failed & (verdict == "rate_limited"), "escalate_browser"),
        ("gate_thin_escalate", LOW, gate & verdict.isin("length_floor", "other") & (c("browser_dispatches") < F.when(bare, 1).otherwise(BROWSERS)), "escalate_browser"),
        ("paid_last_resort", LOW, gate & paid & (c("paid_dispatches") < PAID), "escalate_paid"),
    ]


def decide_next(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (fetch_id, url, url_rewrites, archive_dispatches, browser_dispatches, paid_dispatches) -> (fetch_id, rule, action, target).

    The first rule that holds decides, by priority and then by declaration; none, or an empty log, is "continue". target is
    the rewritten URL, or the URL to look up in an archive.
    """
    seen = requests.join(log_facts(log), "fetch_id", "left")
    ordered = sorted(rules(), key=lambda r: -r[1])
    chosen = F.coalesce(*(F.when(F.col("last").isNotNull() & when, F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"))) for name, _, when, action in ordered))
    target = F.when(F.col("p.action") == "rewrite_url", F.concat(F.lit("https://arxiv.org/abs/"), F.regexp_extract("url", ARXIV_PDF, 1))).when(F.col("p.action") == "retry_via_archive", F.col("url"))
    return seen.withColumn("p", chosen).select("fetch_id", F.col("p.rule").alias("rule"), F.coalesce("p.action", F.lit("continue")).alias("action"), target.alias("target"))


def final_states(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (fetch_id, url, answered) -> (fetch_id, verdict, promoted, outcome, hint, severity) when nothing is left to try.

    A corroborated empty page, or a small one that gave an answer, is ok after all. Any other failed fetch has an outcome and
    the hint that goes with it; what a site said is gone, errors of the operator and unreachable hosts have none here.
    """
    c = F.col
    seen = requests.join(log_facts(log), "fetch_id").withColumn("promoted", F.when(c("verdict") != "ok", promotion(c("url"))))
    saved = F.coalesce((c("promoted") == "empty") | ((c("promoted") == "small") & c("answered")), F.lit(False))
    seen = seen.withColumn("outcome", F.when(~saved, outcome()))
    found = lambda code, severity: F.struct(F.lit(code).alias("hint"), F.lit(severity).alias("severity"))
    hint = F.when(c("promoted") == "empty", found("content_empty", "info")).when(c("outcome") == "wall", found("try_user_browser", "critical")).when((c("outcome") == "gone_confirmed") & ~c("gone_said"), found("content_not_found", "info"))
    hint = hint.when(c("outcome") == "gone_unverified", found("content_not_found", "warning")).when(c("outcome").isin("thin_unverified", "empty_unverified"), found("content_thin", "warning"))
    return seen.select("fetch_id", F.when(saved, "ok").otherwise(c("verdict")).alias("verdict"), "promoted", "outcome", hint["hint"].alias("hint"), hint["severity"].alias("severity"))
