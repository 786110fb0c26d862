"""Registered queries over decision logs: resolution, outcomes, promotions and the next thing to try."""

from __future__ import annotations

from siftpage.operators import log, planner
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query, resolve_sql
from siftpage.plans.retrieval import rows

_WALLS = "('block_page_detected', 'anti_bot', 'paywall', 'blank_page')"
_SHELLS = "('js_required', 'thin_browser_response', 'empty_result')"


def _facts_sql(source: str) -> str:
    return f"""SELECT * FROM ({resolve_sql(source)}) JOIN (
        SELECT fetch_id, arg_max(o, seq) AS last, arg_max(verdict, seq) FILTER (WHERE kind = 'gate_outcome') AS last_gate, bool_or(authoritative AND verdict = 'not_found') AS gone_said,
        count(*) FILTER (WHERE kind = 'tier_outcome' AND verdict = 'not_found') AS gone_seen, bool_or(kind = 'gate_outcome' AND verdict IN {_WALLS}) AS hard_wall,
        coalesce(bool_or(kind = 'gate_outcome' AND subsystem IN {_SHELLS}), false) AS shell, bool_or(blocks > 0) AS blocked, coalesce(bool_or(kind = 'gate_outcome' AND subsystem = 'empty_result'), false) AS marked_empty,
        coalesce(bool_or(subsystem = 'js_required'), false) AS js_required, bool_or(status_code IN (401, 403, 429)) AS challenged,
        coalesce(bool_or(kind = 'gate_outcome' AND source = 'regate' AND subsystem = 'empty_result'), false) AS read_empty, coalesce(bool_or(kind = 'gate_outcome' AND source = 'regate' AND verdict = 'length_floor' AND subsystem = 'thin_fallthrough'), false) AS read_thin
        FROM {source} o GROUP BY fetch_id) USING (fetch_id)"""


_OUTCOME = """CASE WHEN verdict = 'ok' THEN NULL WHEN verdict = 'paid_auth_error' THEN 'operator_error' WHEN verdict IN ('dns_error', 'content_type_mismatch') THEN 'unreachable' WHEN gone_said THEN 'gone_confirmed' WHEN blocked OR hard_wall THEN 'wall'
    WHEN gone_seen >= 2 THEN 'gone_confirmed' WHEN gone_seen = 1 THEN 'gone_unverified' WHEN last_gate = 'length_floor' AND marked_empty THEN 'empty_unverified' WHEN last_gate = 'length_floor' THEN 'thin_unverified' ELSE 'wall' END"""

_LOG = """SELECT event_id // 3 AS fetch_id, event_id AS seq, CASE WHEN event_id % 3 = 2 OR event_id % 8 = 1 THEN 'gate_outcome' ELSE 'tier_outcome' END AS kind,
    CASE WHEN event_id % 13 = 0 THEN 'ok' ELSE CASE event_id % 11 WHEN 0 THEN 'not_found' WHEN 1 THEN 'length_floor' WHEN 2 THEN 'not_found' WHEN 3 THEN 'anti_bot' WHEN 4 THEN 'length_floor' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'dns_error' WHEN 7 THEN 'length_floor' WHEN 8 THEN 'paid_auth_error' ELSE 'timeout' END END AS verdict,
    CASE WHEN event_id % 2 = 0 THEN 'empty_result' ELSE 'thin_fallthrough' END AS subsystem, event_id % 17 = 0 AS authoritative, CASE WHEN event_id % 29 = 0 THEN 2 ELSE 0 END AS blocks,
    CASE WHEN event_id % 4 = 0 THEN 'regate' ELSE 'raw' END AS source, CAST(NULL AS STRING) AS next_tier, CASE WHEN event_id % 7 = 0 THEN 403 WHEN event_id % 5 = 0 THEN 0 ELSE 200 END AS status_code, event_id % 19 = 0 AS cloudflare FROM events"""


@query(f"SELECT fetch_id, verdict, outcome FROM (SELECT *, {_OUTCOME} AS outcome FROM ({_facts_sql(f'({_LOG})')})) WHERE verdict <> 'ok'")
def agg2_terminal_outcomes(spark, sf_dir):
    return log.classify_terminal(rows(spark, sf_dir, _LOG.replace("event_id // 3", "event_id div 3"), "events"))


@query(f"SELECT fetch_id, hard_wall, shell, blocked, marked_empty, last_gate FROM ({_facts_sql(f'({_LOG})')})")
def agg3_win1_evidence(spark, sf_dir):
    return log.log_facts(rows(spark, sf_dir, _LOG.replace("event_id // 3", "event_id div 3"), "events")).select("fetch_id", "hard_wall", "shell", "blocked", "marked_empty", "last_gate")


# (fetch_id, url, url_rewrites, archive_dispatches, browser_dispatches, paid_dispatches, answered), then the log in order:
# kind, source, verdict, subsystem, next_tier, authoritative, status_code, cloudflare, blocks.
_T, _G = "tier_outcome", "gate_outcome"
_tier = lambda verdict, status=200, source="raw", said=False, cloud=False, blocks=0: (_T, source, verdict, None, None, said, status, cloud, blocks)
_gate = lambda verdict, subsystem=None, tier=None, source="gate", blocks=0: (_G, source, verdict, subsystem, tier, False, 200, False, blocks)
_PAGE, _COMMENTS, _SEARCH = "https://example.com/a", "https://old.reddit.com/r/x/comments/1/", "https://example.com/search?q=z"
_CASES = [
    (_PAGE, (0, 0, 0, 0), False, []),
    ("https://arxiv.org/pdf/2101.00001v2.pdf#page=2", (0, 0, 0, 0), False, [_tier("ok")]),
    ("https://arxiv.org/pdf/2101.00001v2", (1, 0, 0, 0), False, [_tier("ok"), _gate("ok")]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("ok"), _gate("anti_bot", "turnstile", "browser")]),
    (_PAGE, (0, 0, 2, 0), False, [_tier("ok"), _gate("anti_bot", "turnstile", "browser")]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("ok"), _gate("anti_bot", "turnstile", "browser")]),
    (_COMMENTS, (0, 0, 0, 0), False, [_tier("not_found", 404)]),
    (_COMMENTS, (0, 0, 0, 0), False, [_gate("length_floor", "js_required", "browser"), _tier("not_found", 404)]),
    (_COMMENTS, (0, 1, 0, 0), False, [_tier("not_found", 200, "site_handler", True)]),
    (_COMMENTS, (0, 0, 0, 0), False, [_tier("not_found", 200, "site_handler", True)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("connection_error", 403, cloud=True)]),
    (_PAGE, (0, 1, 0, 0), False, [_tier("connection_error", 403, cloud=True)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("paywall", 401, "reader")]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("ok"), _gate("paywall")]),
    (_PAGE, (0, 1, 2, 0), False, [_tier("ok"), _gate("paywall")]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("connection_error", 503)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("connection_error", 451)]),
    (_PAGE, (0, 0, 1, 0), False, [_tier("timeout", 0)]),
    (_PAGE, (0, 0, 2, 0), False, [_tier("timeout", 0)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("connection_error", 0)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("not_found", 404)]),
    (_PAGE, (0, 0, 2, 0), False, [_tier("not_found", 404), _tier("not_found", 404, "reader")]),
    (_PAGE, (0, 0, 2, 0), False, [_tier("not_found", 404)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("rate_limited", 429)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("ok"), _gate("length_floor", "thin_fallthrough")]),
    (_PAGE, (0, 0, 1, 0), False, [_tier("ok"), _gate("length_floor", "thin_fallthrough"), _gate("length_floor", "thin_fallthrough", source="regate")]),
    (_PAGE, (0, 0, 1, 0), True, [_tier("ok"), _gate("length_floor", "thin_fallthrough"), _gate("length_floor", "thin_fallthrough", source="regate")]),
    (_PAGE, (0, 0, 1, 0), True, [_tier("ok"), _gate("length_floor", "js_required"), _gate("length_floor", "thin_fallthrough", source="regate")]),
    (_PAGE, (0, 0, 1, 0), False, [_tier("ok"), _gate("other")]),
    (_PAGE, (0, 0, 2, 0), False, [_tier("ok"), _gate("length_floor", "js_required")]),
    (_SEARCH, (0, 0, 1, 0), False, [_tier("ok"), _gate("length_floor", "empty_result"), _gate("length_floor", "empty_result", source="regate")]),
    (_PAGE, (0, 0, 1, 0), False, [_tier("ok"), _gate("length_floor", "empty_result"), _gate("length_floor", "empty_result", source="regate")]),
    (_SEARCH, (0, 0, 1, 0), False, [_tier("ok", blocks=1), _gate("length_floor", "empty_result", source="regate")]),
    (_SEARCH, (0, 0, 1, 0), False, [_tier("connection_error", 429), _tier("ok"), _gate("length_floor", "empty_result", source="regate")]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("timeout", 0), _gate("paywall")]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("ok"), _gate("length_floor"), _tier("not_found", 404, "site_handler", True)]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("dns_error", 0)]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("paid_auth_error", 402, "paid", True), _gate("anti_bot")]),
    (_PAGE, (0, 0, 2, 1), False, [_tier("proxy_unavailable", 0)]),
    (_PAGE, (0, 0, 0, 0), False, [_tier("timeout", 0), _tier("ok"), _gate("ok")]),
]
REQUESTS = Fixture("events: fetch_id int, url string, url_rewrites int, archive_dispatches int, browser_dispatches int, paid_dispatches int, answered boolean", [(i, u, *n, a) for i, (u, n, a, _) in enumerate(_CASES)])
OBSERVATIONS = Fixture(f"events/{len(_CASES)}: fetch_id int, seq int, kind string, source string, verdict string, subsystem string, next_tier string, authoritative boolean, status_code int, cloudflare boolean, blocks int", [(i, k, *o) for i, (*_, log_) in enumerate(_CASES) for k, o in enumerate(log_)])

_FAILED = "kind = 'tier_outcome' AND browser_dispatches < 2"
_RULES = [
    ("arxiv_pdf_rewrite", r"kind IS NOT NULL AND regexp_matches(url, '(?i)^https?://arxiv\.org/pdf/[^/?#]+') AND url_rewrites < 1", "rewrite_url"),
    ("gate_browser_signal", "kind = 'gate_outcome' AND next_tier = 'browser' AND last_verdict <> 'ok' AND browser_dispatches < 2", "escalate_browser"),
    ("reddit_comment_not_found_archive", r"kind = 'tier_outcome' AND last_verdict = 'not_found' AND (authoritative OR status_code = 404) AND regexp_matches(url, '(?i)^https?://((www|old|np)\.)?reddit\.com/r/[^/]+/comments/') AND archive_dispatches < 1 AND NOT js_required", "retry_via_archive"),
    ("cloudflare_403_429_archive", "kind = 'tier_outcome' AND cloudflare AND status_code IN (403, 429) AND archive_dispatches < 1", "retry_via_archive"),
    ("paywall_or_block_archive", "last_verdict IN ('paywall', 'block_page_detected') AND archive_dispatches < 1", "retry_via_archive"),
    ("forbidden_403_escalate", f"{_FAILED} AND last_verdict = 'connection_error' AND status_code = 403", "escalate_browser"),
    ("server_5xx_escalate", f"{_FAILED} AND last_verdict = 'connection_error' AND status_code >= 500", "escalate_browser"),
    ("other_4xx_escalate", f"{_FAILED} AND last_verdict = 'connection_error' AND status_code BETWEEN 400 AND 499", "escalate_browser"),
    ("timeout_escalate", f"{_FAILED} AND last_verdict = 'timeout'", "escalate_browser"),
    ("network_drop_escalate", f"{_FAILED} AND last_verdict = 'connection_error' AND status_code = 0", "escalate_browser"),
    ("uncorroborated_404_escalate", f"{_FAILED} AND last_verdict = 'not_found' AND NOT authoritative", "escalate_browser"),
    ("exhausted_429_escalate", f"{_FAILED} AND last_verdict = 'rate_limited'", "escalate_browser"),
    ("gate_thin_escalate", "kind = 'gate_outcome' AND last_verdict IN ('length_floor', 'other') AND browser_dispatches < CASE WHEN last_verdict = 'length_floor' AND subsystem = 'thin_fallthrough' AND NOT shell AND NOT hard_wall THEN 1 ELSE 2 END", "escalate_browser"),
    ("paid_last_resort", f"kind = 'gate_outcome' AND (last_verdict IN {_WALLS} OR (last_verdict = 'length_floor' AND subsystem = 'js_required')) AND paid_dispatches < 1", "escalate_paid"),
]
_SEEN = f"(SELECT r.*, f.* EXCLUDE (fetch_id, last), last.kind, last.verdict AS last_verdict, last.subsystem, last.next_tier, last.authoritative, last.status_code, last.cloudflare FROM {REQUESTS.sql} r LEFT JOIN ({_facts_sql(OBSERVATIONS.sql)}) f ON f.fetch_id = r.fetch_id)"


@query(f"""
    WITH p AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c, _ in _RULES)} END AS rule FROM {_SEEN}), a AS (SELECT *, CASE rule {' '.join(f"WHEN '{n}' THEN '{a}'" for n, _, a in _RULES)} ELSE 'continue' END AS action FROM p)
    SELECT fetch_id, rule, action, CASE action WHEN 'rewrite_url' THEN 'https://arxiv.org/abs/' || regexp_extract(url, '(?i)/pdf/([^/?#]+?)(\\.pdf)?([/?#].*)?$', 1) WHEN 'retry_via_archive' THEN url END AS target FROM a
""")
def pln1_pln10_decide_next(spark, sf_dir):
    return planner.decide_next(REQUESTS.df(spark, sf_dir), OBSERVATIONS.df(spark, sf_dir))


_CLEAR = "verdict <> 'ok' AND NOT hard_wall AND NOT blocked AND NOT challenged AND tier_ok"


@query(f"""
    WITH f AS (SELECT *, CASE WHEN {_CLEAR} AND read_empty AND regexp_matches(url, '(?i)\\?|/(search|arama|ara|results|sr|find|query)(/|$)') THEN 'empty' WHEN {_CLEAR} AND NOT shell AND read_thin THEN 'small' END AS promoted FROM {_SEEN} WHERE kind IS NOT NULL),
    o AS (SELECT *, CASE WHEN promoted = 'empty' OR (promoted = 'small' AND answered) THEN NULL ELSE {_OUTCOME} END AS outcome FROM f)
    SELECT fetch_id, CASE WHEN verdict <> 'ok' AND outcome IS NULL THEN 'ok' ELSE verdict END AS verdict, promoted, outcome,
    CASE WHEN promoted = 'empty' THEN 'content_empty' WHEN outcome = 'wall' THEN 'try_user_browser' WHEN outcome = 'gone_unverified' OR (outcome = 'gone_confirmed' AND NOT gone_said) THEN 'content_not_found' WHEN outcome IN ('thin_unverified', 'empty_unverified') THEN 'content_thin' END AS hint,
    CASE WHEN promoted = 'empty' THEN 'info' WHEN outcome = 'wall' THEN 'critical' WHEN outcome = 'gone_confirmed' AND NOT gone_said THEN 'info' WHEN outcome IN ('gone_unverified', 'thin_unverified', 'empty_unverified') THEN 'warning' END AS severity FROM o
""")
def pln14_pln15_agg4_agg5_final_states(spark, sf_dir):
    return planner.final_states(REQUESTS.df(spark, sf_dir), OBSERVATIONS.df(spark, sf_dir))


@query(f"SELECT fetch_id, verdict FROM ({_facts_sql(OBSERVATIONS.sql)})")
def agg1_contention_cases(spark, sf_dir):
    return log.resolve_verdicts(OBSERVATIONS.df(spark, sf_dir)).select("fetch_id", "verdict")
