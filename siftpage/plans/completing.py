"""Registered queries over recorded completions: routing envelopes, judges, link lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import completions as C
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query

_FULL = '{"answer": "It is **42** §.", "structural_form": "listing", "shape": "records", "obstacle": "paywalled", "also_here": ["a", "", 3, "b"], "other_pages": [{"handle": 3, "reason": "next", "kind": "structural"}, {"url": "https://x.com/", "kind": "odd"}, {"handle": true}, 7, {"url": ""}], "refinement_axes": [{"dimension": "price", "how": "sort"}, {"how": "x"}, {"dimension": "size", "how": 4}], "item_total_seen": 120, "blocked_gate": 2}'
_TEXTS = [
    _FULL, "```json\n" + _FULL + "\n```", '{"answer": "plain §"}', '{"answer": "half", "structural_form": "article"}', '{"answer": ""}', '{"answer": 5, "shape": "prose"}', '{"structural_form": "article", "shape": "prose"}', "just prose of §", "prose ```json\n{\"answer\": 1\n``` tail",
    '{"answer": "typed", "structural_form": 3, "shape": "", "also_here": "one", "other_pages": {"url": "u"}, "refinement_axes": "", "item_total_seen": true, "blocked_gate": "1"}', '{"answer": "x ```next_links\\n[]\\n``` y", "structural_form": "poem", "shape": "prose", "obstacle": "gone"}', "[1, 2]", "", '{"answer": "n", "structural_form": null, "shape": null, "also_here": null}',
]
ROUTED = Fixture("documents: id int, text string, provider_error string", [(i, t, None) for i, t in enumerate(_TEXTS)] + [(len(_TEXTS), "", "timeout")])

_UNWRAP = r"CASE WHEN regexp_matches(text, '(?s)^\s*```[A-Za-z_]*[ \t]*\n(.*?)\n?```\s*$') THEN regexp_extract(text, '(?s)^\s*```[A-Za-z_]*[ \t]*\n(.*?)\n?```\s*$', 1) ELSE text END"
_PROSE = "trim(regexp_replace({0}, '(?s)```.*?(?:```|$)', '', 'g'))"
_str = lambda n, j="j": f"CASE WHEN json_type({j}, '$.{n}') = 'VARCHAR' THEN nullif(json_extract_string({j}, '$.{n}'), '') END"
_int = lambda n, j="j": f"CASE WHEN json_type({j}, '$.{n}') IN ('BIGINT', 'UBIGINT') THEN json_extract({j}, '$.{n}')::BIGINT END"
_list = lambda n: f"CASE WHEN json_type(j, '$.{n}') = 'ARRAY' THEN json_extract(j, '$.{n}[*]') ELSE [] END"
_bad = lambda n: f"CASE WHEN coalesce(json_type(j, '$.{n}') NOT IN ('ARRAY', 'NULL') AND json_extract(j, '$.{n}')::VARCHAR NOT IN ('\"\"', '{{}}', '0', 'false'), false) THEN '{n}' END"
_absent = lambda n: f"CASE WHEN json_type(j, '$.{n}') IS NULL THEN '{n}' END"


@query(f"""
    WITH p AS (SELECT *, TRY_CAST({_UNWRAP} AS JSON) AS j FROM {ROUTED.sql}), a AS (SELECT *, {_str('answer')} AS ans, {_str('structural_form')} AS f, {_str('shape')} AS s FROM p)
    SELECT id, {_PROSE.format('coalesce(ans, text)')} AS answer, CASE WHEN provider_error IS NOT NULL THEN 'provider_error' WHEN ans IS NULL THEN 'unparsable' WHEN f IS NULL OR s IS NULL THEN 'unclassified' ELSE 'recovered' END AS arm,
    CASE WHEN ans IS NOT NULL THEN f END AS form, CASE WHEN ans IS NOT NULL THEN s END AS shape, CASE WHEN ans IS NOT NULL THEN {_str('obstacle')} END AS obstacle,
    CASE WHEN ans IS NOT NULL THEN array_to_string(list_transform(list_filter({_list('also_here')}, lambda x: json_type(x) = 'VARCHAR' AND (x->>'$') <> ''), lambda x: x->>'$'), '|') END AS also_here,
    CASE WHEN ans IS NOT NULL THEN array_to_string(list_transform(list_filter({_list('other_pages')}, lambda x: json_type(x) = 'OBJECT' AND (json_type(x, '$.handle') IN ('BIGINT', 'UBIGINT') OR (json_type(x, '$.url') = 'VARCHAR' AND (x->>'$.url') <> ''))), lambda x: CASE WHEN json_type(x, '$.handle') IN ('BIGINT', 'UBIGINT') THEN x->>'$.handle' ELSE x->>'$.url' END || ' ' || coalesce({_str('reason', 'x')}, '') || ' ' || CASE WHEN (x->>'$.kind') = 'structural' THEN 'structural' ELSE 'drilldown' END), '|') END AS pages,
    CASE WHEN ans IS NOT NULL THEN array_to_string(list_transform(list_filter({_list('refinement_axes')}, lambda x: json_type(x) = 'OBJECT' AND json_type(x, '$.dimension') = 'VARCHAR' AND (x->>'$.dimension') <> ''), lambda x: (x->>'$.dimension') || '=' || coalesce({_str('how', 'x')}, '')), '|') END AS axes,
    CASE WHEN ans IS NOT NULL THEN {_int('item_total_seen')} END AS item_total_seen, CASE WHEN ans IS NOT NULL THEN {_int('blocked_gate')} END AS blocked_gate,
    CASE WHEN ans IS NOT NULL THEN concat_ws(',', {_absent('structural_form')}, {_absent('shape')}, {_bad('also_here')}, {_bad('other_pages')}, {_bad('refinement_axes')}) END AS wobbles FROM a
""")
def jsn1_jsn2_routed(spark, sf_dir):
    r = ROUTED.df(spark, sf_dir).select("id", C.routed(F.col("text"), F.col("provider_error")).alias("r")).select("id", "r.*")
    page = lambda p: F.concat(F.coalesce(p["handle"].cast("string"), p["url"]), F.lit(" "), p["reason"], F.lit(" "), p["kind"])
    return r.select("id", "answer", "arm", "form", "shape", "obstacle", F.array_join("also_here", "|").alias("also_here"), F.array_join(F.transform("other_pages", page), "|").alias("pages"), F.array_join(F.transform("axes", lambda a: F.concat(a["dimension"], F.lit("="), a["how"])), "|").alias("axes"), "item_total_seen", "blocked_gate", F.array_join("wobbles", ",").alias("wobbles"))


_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"""
    WITH p AS (SELECT *, TRY_CAST({_UNWRAP} AS JSON) AS j FROM {ROUTED.sql}), a AS (SELECT id, {_str('structural_form')} AS f, {_str('shape')} AS s, {_str('obstacle')} AS o FROM p WHERE {_str('answer')} IS NOT NULL),
    w AS (SELECT *, concat_ws(',', CASE WHEN f NOT IN {_in(C.FORMS)} THEN 'structural_form' END, CASE WHEN s NOT IN {_in(C.SHAPES)} THEN 'shape' END, CASE WHEN o NOT IN {_in(C.OBSTACLES)} THEN 'obstacle' END) AS violating FROM a)
    SELECT id, violating, CASE WHEN violating = '' THEN f END AS form, coalesce(violating = '' AND f IN {_in(C.GUIDED)}, false) AS guided FROM w
""")
def flt13_jsn6_projected_routing(spark, sf_dir):
    r = ROUTED.df(spark, sf_dir).select("id", C.routed(F.col("text"), F.col("provider_error")).alias("r")).select("id", "r.*").where("wobbles is not null")
    bad = F.array_join(C.violations(F.col("form"), F.col("shape"), F.col("obstacle")), ",")
    form = F.when(F.col("violating") == "", F.col("form"))
    guide = F.broadcast(spark.createDataFrame([(g, True) for g in C.GUIDED], "kept string, guided boolean"))
    return r.withColumn("violating", bad).select("id", "violating", form.alias("kept")).join(guide, "kept", "left").select("id", "violating", F.col("kept").alias("form"), F.coalesce("guided", F.lit(False)).alias("guided"))


_VERDICTS = ['{"scores": [3, 4], "overall": 4, "reached": false, "reasoning": "ok"}', 'Sure: {"scores": ["5", 2.9, true], "overall": "3"} done', "```json\n{\"scores\": [], \"overall\": 2.9}\n```", '{"scores": [1], "overall": [4]}', '{"scores": ["x"], "overall": 4}', '{"overall": 4}', "no object", '{"scores": [1], "overall": 1, "reached": "yes", "reasoning": null}', "", '{"scores": 3, "overall": 3}', '{"scores": [0], "overall": 3, "reached": null}', '{"scores": [2], "overall": 2, "reached": 0}']
JUDGED = Fixture("documents: id int, text string", list(enumerate(_VERDICTS)))
_INT = r"CASE WHEN json_type({0}) = 'BOOLEAN' THEN ({0})::BOOLEAN::BIGINT WHEN json_type({0}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(({0})::DOUBLE)::BIGINT WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0}->>'$', '^\s*[+-]?[0-9]+\s*$') THEN TRY_CAST(trim({0}->>'$') AS BIGINT) END"


def _judged_sql(j: str) -> str:
    return f"""SELECT id, list_transform(sc, lambda x: {_INT.format('x')}) AS scores, {_INT.format('ov')} AS overall, CASE WHEN re IS NULL THEN ({_INT.format('ov')}) >= 3 ELSE re::VARCHAR NOT IN ('false', '0', '""', 'null', '[]', '{{}}') END AS reached, coalesce(why, '') AS reasoning
        FROM (SELECT id, CASE WHEN json_type(j, '$.scores') = 'ARRAY' THEN json_extract(j, '$.scores[*]') END AS sc, json_extract(j, '$.overall') AS ov, json_extract(j, '$.reached') AS re, json_extract_string(j, '$.reasoning') AS why FROM (SELECT id, TRY_CAST({j} AS JSON) AS j FROM {JUDGED.sql}))
        WHERE sc IS NOT NULL AND ({_INT.format('ov')}) IS NOT NULL AND len(list_filter(sc, lambda x: ({_INT.format('x')}) IS NULL)) = 0"""


@query(rf"""
    WITH one AS ({_judged_sql(_UNWRAP)}), two AS ({_judged_sql(r"nullif(regexp_extract(text, '(?s)\{.*\}'), '')")}), f AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE id NOT IN (SELECT id FROM one))
    SELECT t.id, array_to_string(scores, ',') AS scores, overall, reached, reasoning FROM {JUDGED.sql} t LEFT JOIN f USING (id)
""")
def jsn3_str11_judged(spark, sf_dir):
    r = JUDGED.df(spark, sf_dir).select("id", C.judged(F.col("text")).alias("j"))
    return r.select("id", F.array_join(F.col("j.scores").cast("array<string>"), ",").alias("scores"), "j.overall", "j.reached", "j.reasoning")


CLARITY = Fixture("documents: id int, text string", list(enumerate(['{"clarity": 4, "reasoning": "clear"}', 'I say {"clarity": "3"}.', '{"clarity": null}', '{"reasoning": "x"}', "nothing", '{"clarity": 4.7}'])))


@query(rf"""
    WITH t AS (SELECT id, coalesce(TRY_CAST(text AS JSON), TRY_CAST(nullif(regexp_extract(text, '(?s)\{{.*\}}'), '') AS JSON)) AS j FROM {CLARITY.sql}), s AS (SELECT id, {_INT.format("(j->'$.clarity')")} AS score, coalesce(j->>'$.reasoning', '') AS reasoning FROM t)
    SELECT id, score, CASE WHEN score IS NOT NULL THEN reasoning END AS reasoning FROM s
""")
def jsn4_clarity(spark, sf_dir):
    return CLARITY.df(spark, sf_dir).select("id", C.scored(F.col("text"), "clarity").alias("s")).select("id", "s.score", "s.reasoning")


_LINKED = ['Answer.\n\n```next_links\n[{"anchor": "a", "url": "u", "reason": "r", "kind": "source"}, {"anchor": "b", "url": "v", "reason": "r", "kind": "discussion"}, {"anchor": 1, "url": "w", "reason": "r", "kind": "related"}, 5]\n```', "No links", "Broken\n```next_links\n[{\n```", "Up\n```NEXT_LINKS\n[]\n```\nafter"]
LINKED = Fixture("documents: id int, text string", list(enumerate(_LINKED)))
_FENCE = r"'(?is)```next_links\s*\n(.*?)\n```'"


@query(rf"""
    WITH p AS (SELECT *, regexp_matches(text, {_FENCE}) AS fenced, TRY_CAST(regexp_extract(text, {_FENCE}, 1) AS JSON) AS j FROM {LINKED.sql})
    SELECT id, CASE WHEN fenced THEN rtrim(split_part(regexp_replace(text, '(?i)```next_links', chr(1)), chr(1), 1), ' ' || chr(10)) ELSE text END AS answer,
    coalesce(array_to_string(list_transform(list_filter(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END, lambda x: json_type(x, '$.anchor') = 'VARCHAR' AND json_type(x, '$.url') = 'VARCHAR' AND json_type(x, '$.reason') = 'VARCHAR' AND (x->>'$.kind') IN ('drilldown', 'related', 'source')), lambda x: (x->>'$.kind') || ' ' || (x->>'$.url')), '|'), '') AS links FROM p
""")
def jsn5_str10_split_links(spark, sf_dir):
    r = LINKED.df(spark, sf_dir).select("id", C.split_links(F.col("text")).alias("s"))
    return r.select("id", F.regexp_replace("s.answer", r"\s+$", "").alias("answer"), F.array_join(F.transform("s.links", lambda x: F.concat(x["kind"], F.lit(" "), x["url"])), "|").alias("links"))
