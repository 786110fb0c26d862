"""Registered queries over demands of cases and over envelopes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftpage.operators import contracts as C
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query

_GOOD = {
    "tier": "raw", "status": "ok", "has_content": True, "answer_present": True, "retrieval_incomplete": False, "narrative_present": False, "answer": "See https://x.com/a. and https://made.up/z!", "tokens_full": 900, "next_links_count": 2, "operator_hints": ["listing_partial", "content_thin"], "steps": ["raw", "browser"],
    "content_md": "The body with https://x.com/a in it", "input_menu": "menu text", "narrative": "raw → ok", "hint_severities": {"listing_partial": "info", "content_thin": "warning"}, "confidence": "medium", "page_url": "https://x.com/", "other_pages": [{"url": "https://x.com/p", "anchor": "P", "kind": "drilldown"}, {"url": "https://x.com/q", "anchor": " ", "kind": "structural"}],
    "options": [{"title": "one", "url": "https://x.com/1"}, {"title": "two", "url": None}], "also_here": ["q1"], "refinement_axes": [], "declared_type": "Product", "declared_fields": {"name": "n", "price": "1"}, "declared_omitted": 0}
_BARE: dict = {"status": "failed", "retrieval_incomplete": True, "confidence": "odd"}
OBSERVED = Fixture("documents: slug string, observed string", [("good", json.dumps(_GOOD)), ("bare", json.dumps(_BARE))])
_DEMANDS = {
    "tier": "raw", "status": "ok", "has_content": True, "answer_present": True, "retrieval_incomplete": False, "narrative_present": False, "answer_contains": "https", "tokens_full_max": 800, "next_links_min": 2, "operator_hints": ["listing_partial", "content_thin"], "steps": ["raw"], "content_includes": ["body", "gone"], "content_excludes": ["The", "zzz"],
    "input_menu_includes": ["menu"], "input_menu_excludes": ["menu"], "narrative_includes": ["ok"], "answer_excludes": ["made"], "operator_hints_include": ["content_thin", "try_user_browser"], "operator_hints_exclude": ["listing_partial"], "hint_severity": {"content_thin": "critical", "listing_partial": "info", "x": "info"}, "confidence_max": "low", "other_pages_min": 2,
    "other_pages_kinds": ["drilldown"], "other_pages_all_have_anchor": True, "options_min": 3, "options_max": 1, "options_all_have_url": False, "also_here_min": 1, "index_non_empty": True, "answer_urls_traceable": True, "declared_entity_type": "Product", "declared_fields_min": 3, "declared_omitted_min": 0, "no_such_key": 1}
DEMANDS = Fixture("documents: slug string, key string, expected string", [(s, k, json.dumps(v)) for s in ("good", "bare") for k, v in _DEMANDS.items()])

_o = lambda n: f"json_extract_string(o, '$.{n}')"
_num = lambda n: f"coalesce(TRY_CAST({_o(n)} AS BIGINT), 0)"
_len = lambda n: f"coalesce(json_array_length(o, '$.{n}'), 0)"
_txt, _strs = "json_extract_string(e, '$')", "from_json(e, '[\"VARCHAR\"]')"
_flag = "coalesce(TRY_CAST(json_extract_string(e, '$') AS BOOLEAN), false)"
_hold = lambda n, want: f"len(list_filter({_strs}, lambda x: contains(coalesce({_o(n)}, ''), x) <> {want}))"
_RANK = "CASE {0} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"
_rows = lambda n: f"coalesce(json_extract(o, '$.{n}[*]'), [])"
_CHECKS = {
    **{k: f"CASE WHEN {_o(k)} IS NOT DISTINCT FROM {_txt} THEN 0 ELSE 1 END" for k in ("tier", "status", "confidence")},
    **{k: f"CASE WHEN coalesce(TRY_CAST({_o(k)} AS BOOLEAN), false) = {_flag} THEN 0 ELSE 1 END" for k in ("has_content", "answer_present", "retrieval_incomplete", "narrative_present")},
    "answer_contains": f"CASE WHEN contains(coalesce({_o('answer')}, ''), {_txt}) THEN 0 ELSE 1 END", "tokens_full_max": f"CASE WHEN {_num('tokens_full')} > {_txt}::BIGINT THEN 1 ELSE 0 END", "next_links_min": f"CASE WHEN {_num('next_links_count')} < {_txt}::BIGINT THEN 1 ELSE 0 END",
    **{k: f"CASE WHEN replace(json_extract(o, '$.{k}')::VARCHAR, ' ', '') IS NOT DISTINCT FROM replace(e::VARCHAR, ' ', '') THEN 0 ELSE 1 END" for k in ("operator_hints", "steps")},
    "content_includes": _hold("content_md", "true"), "content_excludes": _hold("content_md", "false"), "input_menu_includes": _hold("input_menu", "true"), "input_menu_excludes": _hold("input_menu", "false"), "narrative_includes": _hold("narrative", "true"), "answer_excludes": _hold("answer", "false"),
    "operator_hints_include": f"len(list_filter({_strs}, lambda x: NOT list_contains(coalesce(json_extract_string(o, '$.operator_hints[*]'), []), x)))", "operator_hints_exclude": f"len(list_filter({_strs}, lambda x: list_contains(coalesce(json_extract_string(o, '$.operator_hints[*]'), []), x)))",
    "hint_severity": "len(list_filter(json_keys(e), lambda k: json_extract_string(o, '$.hint_severities.' || k) IS DISTINCT FROM json_extract_string(e, '$.' || k)))", "confidence_max": f"CASE WHEN coalesce(({_RANK.format(_o('confidence'))}) > ({_RANK.format(_txt)}), true) THEN 1 ELSE 0 END",
    **{f"{n}_min": f"CASE WHEN {_len(n)} < {_txt}::BIGINT THEN 1 ELSE 0 END" for n in ("other_pages", "options", "also_here")}, "options_max": f"CASE WHEN {_len('options')} > {_txt}::BIGINT THEN 1 ELSE 0 END",
    "other_pages_kinds": f"len(list_filter({_rows('other_pages')}, lambda r: NOT list_contains({_strs}, r->>'$.kind')))", "other_pages_all_have_anchor": f"CASE WHEN {_flag} AND len(list_filter({_rows('other_pages')}, lambda r: trim(coalesce(r->>'$.anchor', '')) = '')) = 0 THEN 0 ELSE 1 END",
    "options_all_have_url": f"CASE WHEN {_flag} AND len(list_filter({_rows('options')}, lambda r: trim(coalesce(r->>'$.url', '')) = '')) = 0 THEN 0 ELSE 1 END", "index_non_empty": f"CASE WHEN ({_len('other_pages')} + {_len('options')} + {_len('also_here')} + {_len('refinement_axes')} > 0) = {_flag} THEN 0 ELSE 1 END",
    "answer_urls_traceable": f"""CASE WHEN {_flag} THEN len(list_filter(list_transform(regexp_extract_all(coalesce({_o('answer')}, ''), 'https?://[^\\s<>)\\]"''`]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), lambda u: NOT contains(concat_ws(' ', {_o('content_md')}, {_o('page_url')}, array_to_string(json_extract_string(o, '$.other_pages[*].url'), ' '), array_to_string(json_extract_string(o, '$.options[*].url'), ' ')), u))) ELSE 1 END""",
    "declared_entity_type": f"CASE WHEN {_o('declared_type')} IS NOT DISTINCT FROM {_txt} THEN 0 ELSE 1 END", "declared_fields_min": f"CASE WHEN coalesce(len(json_keys(o, '$.declared_fields')), 0) < {_txt}::BIGINT THEN 1 ELSE 0 END", "declared_omitted_min": f"CASE WHEN {_num('declared_omitted')} < {_txt}::BIGINT THEN 1 ELSE 0 END",
}
del _CHECKS["confidence"]


@query(f"""
    WITH b AS (SELECT d.slug, key, expected::JSON AS e, observed::JSON AS o FROM {DEMANDS.sql} d LEFT JOIN {OBSERVED.sql} USING (slug)),
    f AS (SELECT slug, key, CASE {' '.join(f"WHEN key = '{k}' THEN {v}" for k, v in _CHECKS.items() if k not in C.REPLAY_ONLY)} END AS n FROM b)
    SELECT slug, key, CASE WHEN key = 'no_such_key' THEN 'unknown' WHEN key IN ('steps', 'input_menu_includes', 'input_menu_excludes') THEN 'unsupported' WHEN n > 0 THEN 'failed' ELSE 'passed' END AS result, coalesce(n, 0)::INT AS failed FROM f
""")
def agg30_jon18_set3_case_contracts(spark, sf_dir):
    return C.check(DEMANDS.df(spark, sf_dir), OBSERVED.df(spark, sf_dir), [k for k in C.KEYS if k not in C.REPLAY_ONLY])


@query(f"""
    WITH b AS (SELECT d.slug, key, expected::JSON AS e, observed::JSON AS o FROM {DEMANDS.sql} d LEFT JOIN {OBSERVED.sql} USING (slug) WHERE key IN ('steps', 'input_menu_includes', 'input_menu_excludes', 'content_includes'))
    SELECT slug, key, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS result, n::INT AS failed FROM (SELECT slug, key, CASE {' '.join(f"WHEN key = '{k}' THEN {_CHECKS[k]}" for k in [*C.REPLAY_ONLY, 'content_includes'])} END AS n FROM b)
""")
def agg30_replay_contracts(spark, sf_dir):
    return C.check(DEMANDS.df(spark, sf_dir).where(F.col("key").isin(*C.REPLAY_ONLY, "content_includes")), OBSERVED.df(spark, sf_dir))


_ENVELOPES = Fixture("events: id int, envelope string, requested string, debug boolean", [(i, json.dumps(e), "https://x.com/", i % 2 == 1) for i, e in enumerate([
    {"answer": "x"}, {"status": "ok", "tier": "raw", "url": "https://x.com/"}, {"url": "https://y.com/", "debug": {}}, {"debug": {"t": 1}}, {"next_links": []}, {"next_links": "  "}, {"next_links": "anchor\turl\nA\tu"}, {"retrieval_incomplete": True}, {"retrieval_incomplete": True, "status": "failed", "narrative": "why", "operator_hints": [{"code": "c"}]}, {"retrieval_incomplete": True, "status": "partial", "narrative": " ", "operator_hints": []}, {"retrieval_incomplete": False, "status": "failed"}])])


@query(f"""
    WITH e AS (SELECT *, envelope::JSON AS v, coalesce((envelope::JSON->>'$.retrieval_incomplete')::BOOLEAN, false) AS inc FROM {_ENVELOPES.sql})
    SELECT id, concat_ws(',', CASE WHEN v->>'$.status' = 'ok' THEN 'status_default' END, CASE WHEN v->>'$.tier' = 'raw' THEN 'tier_default' END, CASE WHEN v->>'$.url' = requested THEN 'url_as_requested' END, CASE WHEN json_exists(v, '$.debug') AND NOT debug THEN 'debug_unasked' END,
    CASE WHEN json_exists(v, '$.next_links') AND NOT (json_type(v, '$.next_links') = 'VARCHAR' AND trim(v->>'$.next_links') <> '') THEN 'next_links_no_table' END, CASE WHEN inc AND (v->>'$.status') IS DISTINCT FROM 'failed' THEN 'incomplete_not_failed' END,
    CASE WHEN inc AND trim(coalesce(v->>'$.narrative', '')) = '' THEN 'incomplete_no_narrative' END, CASE WHEN inc AND coalesce(json_array_length(v, '$.operator_hints'), 0) = 0 THEN 'incomplete_no_hint' END) AS broken FROM e
""")
def agg29_envelope_violations(spark, sf_dir):
    return _ENVELOPES.df(spark, sf_dir).select("id", F.array_join(C.envelope_violations(F.col("envelope"), F.col("requested"), F.col("debug")), ",").alias("broken"))
