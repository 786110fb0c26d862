"""Registered queries over what a fetch answers, and over keyed state."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftpage.functions import patterns as P
from siftpage.operators import responses as R
from siftpage.operators import state as S
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import _q, query, table
from siftpage.plans.retrieval import rows

_LISTS = Fixture("events: id int, records int, oracle int, more boolean, read_total int", [(0, None, 100, True, 100), (1, 20, 100, True, None), (2, 95, 100, True, None), (3, 20, None, True, None), (4, 20, None, False, None), (5, 20, None, True, 80), (6, 20, None, False, 21), (7, 0, 50, False, None), (8, 20, 20, True, 500), (9, 90, 100, False, None)])


@query(f"""
    WITH r AS (SELECT *, CASE WHEN oracle IS NULL THEN 'ready' WHEN oracle > 0 AND records = 0 THEN 'fail' WHEN records >= oracle * 0.9 THEN 'ready' ELSE 'partial' END AS own, CASE WHEN read_total IS NULL THEN 'ready' WHEN read_total > 0 AND records = 0 THEN 'fail' WHEN records >= read_total * 0.9 THEN 'ready' ELSE 'partial' END AS read FROM {_LISTS.sql}),
    k AS (SELECT *, CASE WHEN records IS NULL THEN NULL WHEN oracle IS NOT NULL THEN CASE WHEN own = 'partial' THEN 'own' END WHEN read = 'partial' THEN 'read' WHEN more THEN 'more' END AS via FROM r)
    SELECT id, CASE WHEN via IS NOT NULL THEN records END AS loaded, CASE via WHEN 'own' THEN oracle WHEN 'read' THEN read_total END::BIGINT AS total, CASE WHEN via IS NOT NULL THEN via = 'more' END AS more FROM k
""")
def agg9_agg10_listing_states(spark, sf_dir):
    c = F.col
    return _LISTS.df(spark, sf_dir).select("id", R.listing_state(c("records"), c("oracle"), c("more"), c("read_total")).alias("s")).select("id", "s.loaded", "s.total", "s.more")


_SHELL, _STATIC = '<script src="a"></script><div id="root"></div>', "<script></script><noscript></noscript>"
_RENDERS = Fixture("events: id int, asked boolean, obstacle string, paid int, tier string, content string, html string, total int, enabled boolean", [(0, True, "empty", 0, "raw", "thin", _SHELL, 100, True), (1, False, "empty", 0, "raw", "thin", _SHELL, 100, True), (2, True, "paywalled", 0, "raw", "thin", _SHELL, 301, True), (3, True, "blocked", 1, "raw", "thin", _SHELL, 300, True), (4, True, "blocked", 0, "browser", "thin", _SHELL, 10, True), (5, True, "blocked", 0, "raw", "x" * 2000, _SHELL, None, True), (6, True, "blocked", 0, "raw", "thin", _STATIC, 10, False), (7, True, None, 0, "raw", "thin", _SHELL, 300, True)])


@query(f"""
    SELECT id, coalesce(asked AND obstacle IN ('empty', 'blocked') AND paid < 1 AND tier NOT IN ('reader', 'browser', 'browser_robust') AND length(content) < 2000 AND regexp_matches(html, {_q(P.SCRIPT)}) AND regexp_matches(html, {_q(P.SPA_MOUNT)}), false) AS obstacle_render,
    coalesce(enabled AND asked AND total IS NOT NULL AND paid < 1 AND tier NOT IN ('reader', 'browser', 'browser_robust') AND total <= 300, false) AS listing_render FROM {_RENDERS.sql}
""")
def flt9_wanted_renders(spark, sf_dir):
    c = F.col
    return _RENDERS.df(spark, sf_dir).select("id", R.wants_obstacle_render(c("asked"), c("obstacle"), c("paid"), c("tier"), c("content"), c("html")).alias("obstacle_render"), R.wants_listing_render(c("enabled"), c("asked"), c("total"), c("paid"), c("tier")).alias("listing_render"))


_HINTS = Fixture("events: id int, confidence string, hints string", [(i, c, json.dumps([dict(zip(("code", "fix", "severity"), h)) for h in hs])) for i, (c, hs) in enumerate([("high", [("content_empty", None, "info"), ("content_thin", "Look.", "warning"), ("try_user_browser", None, "critical")]), ("low", [("content_empty", "x", "info")]), ("high", []), ("low", [("content_thin", "Call report_feedback(a)", "critical")]), ("medium", [("nope", None, "critical")])])])
_TOLD = Fixture("events/5: id int, codes string, fixes string, undeclared string", [(0, "content_empty,content_thin,try_user_browser", "Look." + R.SENTENCE, ""), (1, "content_empty,report_feedback_available", "x", ""), (2, "", "", ""), (3, "content_thin", "Call report_feedback(a)", ""), (4, "nope", R.SENTENCE, "nope")])


@query(f"SELECT * FROM {_TOLD.sql}")
def pln19_flt7_nudged_hints(spark, sf_dir):
    h = F.from_json("hints", "array<struct<code:string,fix:string,severity:string>>")
    told = _HINTS.df(spark, sf_dir).select("id", R.nudged(h, F.col("confidence")).alias("h"))
    unknown = F.filter(F.transform("h", lambda x: x["code"]), lambda c: ~c.isin(R.HINT_CODES))
    return told.select("id", F.array_join(F.transform("h", lambda x: x["code"]), ",").alias("codes"), F.array_join(F.array_compact(F.transform("h", lambda x: x["fix"])), ",").alias("fixes"), F.array_join(unknown, ",").alias("undeclared"))


_ENDS = Fixture("events: id int, verdict string, empty_ok boolean, small_ok boolean, asked boolean, answer string, chars int, extracted boolean, grounded boolean, unavailable boolean, render boolean, outcome string, arm string, listed int", [
    (0, "ok", False, False, True, "yes", 900, True, False, False, False, None, "recovered", 0), (1, "ok", False, False, True, " ", 900, True, False, False, False, None, "unparsable", 0), (2, "ok", False, False, True, None, 100, True, False, False, False, None, "unparsable", 2), (3, "ok", False, False, True, None, 100, True, True, False, False, None, "unclassified", 0), (4, "ok", False, False, False, None, 900, False, False, True, False, None, None, 0),
    (5, "ok", False, False, True, None, 900, False, False, True, False, None, "provider_error", 0), (6, "length_floor", True, False, True, None, 9, False, False, False, False, None, None, 0), (7, "length_floor", False, True, True, "a", 9, True, False, False, False, None, "recovered", 0), (8, "length_floor", False, False, True, None, 9, False, False, False, False, "thin_unverified", None, 0), (9, "not_found", False, False, True, None, 0, False, False, False, False, "gone_confirmed", None, 0),
    (10, "not_found", False, False, True, None, 0, False, False, False, True, "gone_confirmed", None, 0), (11, "paid_auth_error", False, False, True, None, 0, False, False, False, False, "operator_error", None, 0), (12, "anti_bot", False, False, False, None, 0, False, False, False, False, "wall", None, 0)])


@query(f"""
    WITH e AS (SELECT *, verdict = 'ok' OR empty_ok OR small_ok AS good, verdict = 'ok' AND asked AND ((extracted AND trim(coalesce(answer, '')) = '' AND (chars > 500 OR grounded)) OR unavailable) AS unanswered FROM {_ENDS.sql}), f AS (SELECT *, NOT good OR unanswered AS failed FROM e)
    SELECT id, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status, verdict = 'paid_auth_error' OR unanswered OR (failed AND render) OR (failed AND coalesce(outcome IN ('wall', 'gone_unverified', 'thin_unverified', 'empty_unverified'), false)) AS incomplete, coalesce(arm IN ('unparsable', 'unclassified') AND listed = 0, false) AS index_lost FROM f
""")
def prj10_prj9_pln20_statuses(spark, sf_dir):
    c = F.col
    s = R.status(c("verdict"), c("empty_ok"), c("small_ok"), c("asked"), c("answer"), c("chars"), c("extracted"), c("grounded"), c("unavailable"), c("render"), c("outcome"))
    lost = R.index_lost(c("arm"), F.array_repeat(F.lit(1), c("listed")), F.array().cast("array<int>"))
    return _ENDS.df(spark, sf_dir).select("id", s.alias("s"), F.coalesce(lost, F.lit(False)).alias("index_lost")).select("id", "s.status", "s.incomplete", "index_lost")


_WIRES = Fixture("events: id int, status string, tier string, confidence string, answer string, narrative string, links array<string>, retrieval_incomplete boolean, total_ms int, extraction string", [(0, "ok", "raw", "high", "a", "raw → ok", [], False, None, ""), (1, "failed", "browser", "low", None, "why", ["x"], True, 12, "e"), (2, "ok", "paid", "", "", "n", None, None, 5, None)])
_WIRED = Fixture("events/3: id int, wire string", [(0, '{"confidence":"high","answer":"a"}'), (1, '{"status":"failed","tier":"browser","confidence":"low","narrative":"why","links":["x"],"retrieval_incomplete":true,"debug":{"total_ms":12,"extraction":"e"}}'), (2, '{"tier":"paid","confidence":"","answer":"","debug":{"total_ms":5}}')])


@query(f"SELECT * FROM {_WIRED.sql}")
def prj2_snk2_pruned_wire(spark, sf_dir):
    w = _WIRES.df(spark, sf_dir)
    wire = R.pruned(w.drop("id"), ["confidence", "answer"], {"status": "ok", "tier": "raw"}, ["narrative"], ["total_ms", "extraction"])
    return w.select("id", wire.alias("wire"))


_ASKS = Fixture("events: id int, query string, titles array<string>", [(0, "pindstrup price", ["Shade cloth 3x4", "Garden net"]), (1, "Pİndstrup compare", ["PINDSTRUP peat 70l", "x"]), (2, "price stock", ["Anything"]), (3, "lamp", []), (4, "café lamp", ["The CAFÉ set"]), (5, "a b", ["zz"]), (6, "RTX 4090 best", ["Graphics RTX"])])
_OPS = ["price", "stock", "best", "compare"]


@query("SELECT event_id AS id, event_id % 7 = 0 AS off_target FROM events")
def str4_set2_jon17_off_target(spark, sf_dir):
    each = _ASKS.df(spark, sf_dir).select("id", "query", F.explode_outer("titles").alias("title"))
    tokens = each.select("id", R.query_tokens("query").alias("q"), F.when(F.col("title").isNotNull(), R.query_tokens("title")).alias("t"))
    g = tokens.groupBy("id").agg(F.first("q").alias("q"), F.collect_list("t").alias("ts"))
    return g.select("id", R.off_target(F.col("q"), F.col("ts"), _OPS).alias("off_target"))


_TRIES = Fixture("events: id int, url string, variant string, status_code int, conditional_hit boolean, body string", [(0, "u1", "a", 304, True, ""), (1, "u2", "a", 304, True, ""), (2, "u1", "b", 304, True, ""), (3, "u1", "a", 200, False, "new"), (4, "u1", "a", 304, False, "odd")])
_ROWS = Fixture("url string, variant string, etag string, last_modified string, body string", [("u1", "a", "e1", None, "old"), ("u3", "a", None, "m", "other")])


@query(f"SELECT id, CASE WHEN NOT (status_code = 304 AND conditional_hit) THEN 'not_conditional' WHEN r.url IS NOT NULL THEN 'reused' ELSE 'unusable' END AS outcome, etag, last_modified, CASE WHEN NOT (status_code = 304 AND conditional_hit) THEN t.body ELSE r.body END AS body FROM {_TRIES.sql} t LEFT JOIN {_ROWS.sql} r ON r.url = t.url AND r.variant = t.variant")
def pln17_conditional(spark, sf_dir):
    return R.conditional(_TRIES.df(spark, sf_dir), _ROWS.df(spark, sf_dir))


_PRODUCED = Fixture("pages: page_id int, pos int, url string, via string", [(0, 0, "h1", "handler"), (0, 0, "m1", "mined"), (1, 0, "m2", "mined"), (1, 1, "m3", "mined"), (1, 0, "l1", "listed"), (2, 0, "l2", "listed")])


@query(f"WITH r AS (SELECT *, CASE via WHEN 'handler' THEN 0 WHEN 'mined' THEN 1 ELSE 2 END AS k FROM {_PRODUCED.sql}) SELECT page_id, pos, url, via FROM r WHERE k = (SELECT min(k) FROM r s WHERE s.page_id = r.page_id)")
def pln21_merged_links(spark, sf_dir):
    p = _PRODUCED.df(spark, sf_dir)
    return R.merged_links(*(p.where(F.col("via") == b).select("page_id", "pos", "url") for b in ("handler", "mined", "listed")))


_WRITES = "SELECT event_id, user_id AS url, event_type AS variant, CAST(epoch AS DOUBLE) AS fetched_at, CASE WHEN value < 20 THEN 300.0 WHEN value < 60 THEN 86400.0 ELSE 604800.0 END AS ttl FROM (SELECT *, event_id * 977 % 2000003 AS epoch FROM events) t"


@query(f"""
    WITH w AS (SELECT * FROM ({_WRITES}) WHERE event_id % 2 = 0), r AS (SELECT event_id AS id, url, variant, fetched_at AS asked FROM ({_WRITES}) WHERE event_id % 2 = 1)
    SELECT id, w.fetched_at, coalesce(w.fetched_at + w.ttl > asked, false) AS hit FROM r ASOF LEFT JOIN w ON r.url = w.url AND r.variant = w.variant AND r.asked >= w.fetched_at
""")
def jon9_cache_as_of(spark, sf_dir):
    e = rows(spark, sf_dir, _WRITES, "events")
    return S.cache_hits(e.where("event_id % 2 = 1").select(F.col("event_id").alias("id"), "url", "variant", F.col("fetched_at").alias("at")), e.where("event_id % 2 = 0"))


_STORES = Fixture("events: id int, verdict string, cache_state string, bypass boolean, tier string, body string", [(0, "ok", "miss", False, "raw", "b"), (1, "ok", "hit", False, "raw", "b"), (2, "ok", "miss", True, "raw", "b"), (3, "ok", "miss", False, "archive", "b"), (4, "ok", "miss", False, "raw", ""), (5, "anti_bot", "miss", False, "raw", "b"), (6, "ok", "stale", False, "paid", None)])


@query(f"SELECT id FROM {_STORES.sql} WHERE verdict = 'ok' AND cache_state <> 'hit' AND NOT bypass AND tier <> 'archive' AND coalesce(length(body), 0) > 0")
def snk3_cache_writes(spark, sf_dir):
    c = F.col
    return _STORES.df(spark, sf_dir).where(S.cacheable(c("verdict"), c("cache_state"), c("bypass"), c("tier"), c("body"))).select("id")


_REPORTS = "SELECT user_id AS proxy, event_id AS seq, CAST(event_id AS DOUBLE) AS told, event_id % 3 = 0 OR value > 80 AS success FROM events"


@query(f"""
    WITH e AS (SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY proxy ORDER BY seq) AS island FROM ({_REPORTS})),
    f AS (SELECT *, CASE WHEN success THEN 0 ELSE count(*) FILTER (WHERE NOT success) OVER (PARTITION BY proxy, island ORDER BY seq) END AS failures FROM e)
    SELECT proxy, seq, failures, CASE WHEN failures >= 3 THEN told + 600 ELSE 0 END AS quarantined_until FROM f
""")
def s4_quarantine(spark, sf_dir):
    return S.proxy_health(rows(spark, sf_dir, _REPORTS, "events").withColumnRenamed("told", "at").withColumn("proxy", F.col("proxy").cast("string"))).withColumn("proxy", F.col("proxy").cast("long"))


_RULES = Fixture("idx int, host string, tier string, proxy string, required boolean", [(0, "*.example.com", "browser", "eu", True), (1, "example.net", None, "direct", True), (2, "*.org", None, "gone", True), (3, None, "paid", "us", False), (4, "*", None, "eu", False)])
_PROXIES = Fixture("proxy string, url string", [("eu", "http://eu"), ("us", "http://us")])
_ASKED = "SELECT page_id AS id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, CASE page_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'browser' ELSE 'paid' END AS tier FROM pages"


@query(f"""
    WITH m AS (SELECT q.id, arg_min({{'idx': idx, 'proxy': proxy, 'required': required}}, idx) AS r FROM ({_ASKED}) q JOIN {_RULES.sql} r ON (coalesce(r.host, '') IN ('', '*', lower(q.host)) OR (r.host LIKE '*.%' AND (lower(q.host) = r.host[3:] OR lower(q.host) LIKE '%.' || r.host[3:]))) AND (r.tier IS NULL OR r.tier = q.tier) GROUP BY q.id)
    SELECT q.id, m.r.idx AS idx, CASE WHEN m.r.proxy = 'direct' THEN 'direct' WHEN p.url IS NOT NULL THEN m.r.proxy END AS proxy, p.url, coalesce(m.r.required AND p.url IS NOT NULL, false) AS required FROM ({_ASKED}) q LEFT JOIN m USING (id) LEFT JOIN {_PROXIES.sql} p ON p.proxy = m.r.proxy
""")
def jon6_routes(spark, sf_dir):
    return S.routes(rows(spark, sf_dir, _ASKED.replace("[a-zA-Z]", "[a-zA-Z]"), "pages"), _RULES.df(spark, sf_dir), _PROXIES.df(spark, sf_dir))


@query("SELECT page_id, host, fresh FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, page_id % 2 = 0 AS fresh FROM pages) p WHERE fresh OR host NOT IN (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) FROM pages WHERE page_id % 2 = 0)")
def snk8_mirror(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"), (F.col("page_id") % 2 == 0).alias("fresh"))
    return S.mirror(p.where(~F.col("fresh")), p.where("fresh"), ["host"])
