"""Registered queries over evaluation rows derived from the documents, and over events and envelopes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftpage.operators import reports as R
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query, table
from siftpage.plans.retrieval import rows

_EVAL = """SELECT doc_id AS slug, source AS system, lang AS class, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 6 END AS quality, CASE WHEN doc_id % 7 = 0 THEN 'unscored' ELSE 'scored' END AS quality_disposition, CASE WHEN doc_id % 14 = 0 THEN 'timeout' WHEN doc_id % 7 = 0 THEN 'bad json' END AS quality_reason,
    n_chars % 900 AS tokens, CASE WHEN doc_id % 30 = 0 OR doc_id % 41 = 1 THEN NULL ELSE (n_chars + 1) % 6 END AS clarity, CASE WHEN doc_id % 30 = 0 THEN 'not_applicable' WHEN doc_id % 41 = 1 THEN 'unscored' ELSE 'scored' END AS clarity_disposition, CASE WHEN doc_id % 41 = 1 THEN 'no verdict' END AS clarity_reason,
    CASE WHEN doc_id % 3 = 0 THEN n_chars % 2 = 0 END AS conformant, CAST(NULL AS BIGINT) AS next_links, CASE WHEN doc_id % 50 = 3 THEN 'unscored' ELSE 'not_applicable' END AS next_links_disposition, CASE WHEN doc_id % 50 = 3 THEN 'no verdict' END AS next_links_reason,
    n_chars % 5 AS fetch_cost, doc_id % 3 AS judge_cost, CASE WHEN doc_id % 11 = 0 THEN 'dns' END AS fetch_error FROM documents"""


def _eval(spark, sf_dir):
    return rows(spark, sf_dir, _EVAL, "documents")


@query(f"""
    WITH g AS (SELECT system, count(*) AS n, round(avg(quality), 9) AS quality, count(quality) AS quality_n, round(avg(tokens) FILTER (WHERE tokens > 0), 9) AS tokens, count(*) FILTER (WHERE tokens > 0) AS tokens_n, round(avg(clarity), 9) AS clarity, count(clarity) AS clarity_n, round(avg(next_links), 9) AS next_links, count(next_links) AS next_links_n, count(*) FILTER (WHERE conformant) AS conformant, count(conformant) AS conformant_n FROM ({_EVAL}) GROUP BY system)
    SELECT g.*, CASE WHEN g.system <> 'src1' THEN round(g.quality - b.quality, 9) END AS quality_delta, CASE WHEN g.system <> 'src1' THEN round(g.tokens - b.tokens, 9) END AS tokens_delta, CASE WHEN g.system <> 'src1' THEN round(g.clarity - b.clarity, 9) END AS clarity_delta FROM g LEFT JOIN g b ON b.system = 'src1'
""")
def agg19_axes_against_baseline(spark, sf_dir):
    return R.axes(_eval(spark, sf_dir), "src1")


@query(f"""
    WITH c AS (SELECT unnest(['quality', 'clarity', 'next_links']) AS axis, system, unnest([quality_disposition, clarity_disposition, next_links_disposition]) AS d FROM ({_EVAL})),
    g AS (SELECT axis, system, grouping(system) AS every, count(*) FILTER (WHERE d = 'scored') AS scored, count(*) FILTER (WHERE d = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE d = 'unscored') AS unscored FROM c GROUP BY GROUPING SETS ((axis, system), (axis)))
    SELECT axis, system, scored, not_applicable, unscored, scored + unscored AS requested, every = 0 AND scored > 0 AND scored < 0.9 * (scored + unscored) AS thin, every = 1 AND scored + unscored > 0 AND scored = 0 AS broken FROM g
""")
def agg14_agg15_agg16_coverage(spark, sf_dir):
    return R.coverage(R.dispositions(_eval(spark, sf_dir)))


@query(f"""
    WITH c AS (SELECT unnest(['quality', 'clarity', 'next_links']) AS axis, unnest([quality_disposition, clarity_disposition, next_links_disposition]) AS d, unnest([quality_reason, clarity_reason, next_links_reason]) AS reason FROM ({_EVAL}))
    SELECT axis, reason, count(*) AS n, row_number() OVER (PARTITION BY axis ORDER BY count(*) DESC, reason)::INT AS place FROM c WHERE d = 'unscored' GROUP BY axis, reason
""")
def agg22_srt4_reasons_by_axis(spark, sf_dir):
    from pyspark.sql import Window

    n = R.dispositions(_eval(spark, sf_dir)).where("disposition = 'unscored'").groupBy("axis", "reason").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("n"), "reason")))


@query(f"SELECT system, count(*) AS n, sum(fetch_cost)::BIGINT AS fetched, sum(judge_cost)::BIGINT AS judged, (sum(fetch_cost) + sum(judge_cost))::BIGINT AS total, round(coalesce(avg(quality), 0), 9) AS mean, CASE WHEN avg(quality) > 0 THEN round((sum(fetch_cost) + sum(judge_cost)) / avg(quality), 9) END AS per_point FROM ({_EVAL}) GROUP BY ROLLUP (system)")
def agg20_costs(spark, sf_dir):
    return R.costs(_eval(spark, sf_dir))


@query(f"""
    WITH e AS (SELECT 'fetch' AS kind, slug, system, fetch_error AS reason FROM ({_EVAL}) WHERE fetch_error IS NOT NULL UNION ALL SELECT 'judge', slug, system, quality_reason FROM ({_EVAL}) WHERE quality_disposition = 'unscored'),
    p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY slug, system)::INT AS place, count(*) OVER (PARTITION BY kind) AS total FROM e) SELECT kind, place, slug, system, reason, total FROM p WHERE place <= 20
""")
def agg21_first_errors(spark, sf_dir):
    return R.first_errors(_eval(spark, sf_dir))


@query(f"""
    WITH g AS (SELECT system, avg(quality) AS mean_overall, avg(tokens) FILTER (WHERE tokens > 0) AS mean_envelope_tokens, avg(clarity) AS mean_clarity, avg(next_links) AS mean_next_links, count(*) FILTER (WHERE conformant) / nullif(count(conformant), 0) AS contract_pass, sum(fetch_cost + judge_cost)::DOUBLE AS cost FROM ({_EVAL}) GROUP BY system)
    SELECT metric, system, round(value, 9) AS value FROM (UNPIVOT g ON mean_overall, mean_envelope_tokens, mean_clarity, mean_next_links, contract_pass, cost INTO NAME metric VALUE value)
""")
def agg23_headline(spark, sf_dir):
    return R.headline(_eval(spark, sf_dir))


_PAIRS = "SELECT lang AS cap, n_chars % 6 AS a, (n_chars + doc_id % 4) % 6 AS b FROM documents"


@query(f"WITH g AS (SELECT cap, count(*) AS n, avg(a - b) AS mean, 1.96 * stddev_samp(a - b) / sqrt(count(*)) AS half FROM ({_PAIRS}) GROUP BY cap) SELECT cap, n, round(mean, 9) AS mean, round(mean - half, 9) AS low, round(mean + half, 9) AS high, mean - half > 0 OR mean + half < 0 AS differs FROM g")
def agg32_contrast(spark, sf_dir):
    return R.contrast(rows(spark, sf_dir, _PAIRS, "documents"), "cap", "a", "b")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS loaded, count(*) AS total, count(*) FILTER (WHERE role = 'assistant') < count(*) AS partial FROM conversations GROUP BY conv_id")
def agg33_partial_counts(spark, sf_dir):
    loaded = F.count_if(F.coalesce(F.col("role") == "assistant", F.lit(False)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(loaded.alias("loaded"), F.count(F.lit(1)).alias("total"), (loaded < F.count(F.lit(1))).alias("partial"))


@query(f"SELECT slug, system, quality_disposition, quality AS quality_value, clarity_disposition, clarity AS clarity_value, next_links_disposition, next_links AS next_links_value, tokens AS tokens_total FROM ({_EVAL})")
def prj11_flat_rows(spark, sf_dir):
    """Nested axes, each with its disposition beside its value, are made flat where rows are written."""
    axis = lambda n: F.struct(F.col(f"{n}_disposition").alias("disposition"), F.col(n).alias("value")).alias(n)
    nested = _eval(spark, sf_dir).select("slug", "system", axis("quality"), axis("clarity"), axis("next_links"), F.struct(F.col("tokens").alias("total")).alias("tokens"))
    return nested.select("slug", "system", *(F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in R.JUDGED for f in ("disposition", "value")), F.col("tokens.total").alias("tokens_total"))


@query(f"SELECT slug, system FROM ({_EVAL}) WHERE class IN ('de', 'fr') AND quality_disposition = 'scored' AND slug NOT IN (3, 5)")
def lim4_corpus_subset(spark, sf_dir):
    return _eval(spark, sf_dir).where(F.col("class").isin("de", "fr") & (F.col("quality_disposition") == "scored") & ~F.col("slug").isin(3, 5)).select("slug", "system")


_HINTS = Fixture("events: id int, rows string", [(i, json.dumps(r)) for i, r in enumerate([[{"code": "a", "message": "one\ttab"}, {"code": "b", "message": "two\nlines", "severity": "critical"}], [], [{"x": "back\\slash"}, {"y": "cr\r"}, {}], [{"only": None}]])])


@query(r"""
    WITH r AS (SELECT id, unnest(CASE WHEN json_array_length(rows) = 0 THEN [NULL] ELSE json_extract(rows, '$[*]') END) AS r, generate_subscripts(CASE WHEN json_array_length(rows) = 0 THEN [NULL] ELSE json_extract(rows, '$[*]') END, 1) AS i FROM (SELECT id, rows::JSON AS rows FROM """ + _HINTS.sql + r""")),
    k AS (SELECT id, i, unnest(json_keys(r)) AS k, generate_subscripts(json_keys(r), 1) AS j FROM r WHERE r IS NOT NULL), c AS (SELECT id, list(k ORDER BY f) AS ks FROM (SELECT id, k, min(i * 1000 + j) AS f FROM k GROUP BY ALL) GROUP BY id),
    l AS (SELECT r.id, i, array_to_string(list_transform(ks, lambda x: coalesce(replace(replace(replace(replace(r->>('$.' || x), '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), '')), chr(9)) AS line FROM r JOIN c USING (id) WHERE r IS NOT NULL)
    SELECT h.id, coalesce(array_to_string(ks, chr(9)), '') AS head, (SELECT string_agg(line, chr(10) ORDER BY i) FROM l WHERE l.id = h.id) AS body FROM """ + _HINTS.sql + """ h LEFT JOIN c USING (id)
""")
def snk1_snk2_union_table(spark, sf_dir):
    entries = F.transform(F.from_json("rows", "array<map<string,string>>"), F.map_entries)
    t = _HINTS.df(spark, sf_dir).select("id", R.tsv(entries).alias("t"))
    body = F.expr("substring(t, locate('\\n', t) + 1)")
    return t.select("id", F.split_part("t", F.lit("\n"), F.lit(1)).alias("head"), F.when(F.locate("\n", "t") > 0, body).alias("body"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'TierEnded' WHEN 'view' THEN 'TierStarted' ELSE 'StageEnded' END AS name, user_id AS step, value AS dur_ms FROM events WHERE event_type <> 'view'")
def snk5_prj14_span_sink(spark, sf_dir):
    """Typed events become a name and a payload; only those that end a phase are kept."""
    name = F.when(F.col("event_type") == "click", "TierEnded").when(F.col("event_type") == "view", "TierStarted").otherwise("StageEnded")
    e = table(spark, sf_dir, "events").select("event_id", name.alias("name"), F.to_json(F.struct(F.col("user_id").alias("step"), F.col("value").alias("dur_ms"))).alias("payload"))
    p = F.from_json("payload", "step bigint, dur_ms double")
    return e.where(F.col("name").endswith("Ended")).select("event_id", "name", p["step"].alias("step"), p["dur_ms"].alias("dur_ms"))


_TIERS = Fixture("events: id int, name string, priority int, declared int", [(0, *t) for t in [("reader", 10, 0), ("raw", 20, 1), ("site_handler", 30, 2), ("browser", -1, 3), ("archive", -1, 4), ("paid", -1, 5)]])


@query(f"SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY priority DESC, declared)::INT AS place FROM {_TIERS.sql} WHERE priority >= 0")
def srt2_tier_order(spark, sf_dir):
    """The tiers of the walk, the highest priority first; those below zero are only ever dispatched to."""
    from pyspark.sql import Window

    return _TIERS.df(spark, sf_dir).where("priority >= 0").select("id", "name", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), "declared")).alias("place"))
