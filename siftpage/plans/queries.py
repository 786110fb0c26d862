"""Registered queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.functions import patterns as P
from siftpage.functions.gate import gate, visible_text
from siftpage.operators import links, log, scores

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_q = lambda s: "'" + s.replace("'", "''") + "'"
_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace({0}, " + _q(P.CODE_BLOCK) + r", ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HOST = r"lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_NORM = r"regexp_replace(split_part({0}, '#', 1), '/+$', '')"
_SITE = "array_to_string(list_slice(string_split(regexp_replace(" + _HOST + r", '^www\.', ''), '.'), -2, -1), '.')"


@query(f"SELECT page_id, length({_VISIBLE.format('html')}) AS visible_length FROM pages")
def vis1_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(visible_text(F.col("html"))).alias("visible_length"))


def gate_sql(pages: str, key: str) -> str:
    """SQL over pages (key, md, html, content_type) that adds verdict, subsystem and next_tier."""
    m = lambda p, c="html": f"regexp_matches({c}, {_q(p)})"
    rungs = [
        ("coalesce(content_type, '') <> '' AND NOT contains(lower(content_type), 'html')", "content_type_mismatch", None, None),
        (m(P.TURNSTILE), "anti_bot", "turnstile", "browser"), (m(P.AKAMAI), "anti_bot", "akamai_bmp", "browser"), (f"{m(P.ANUBIS)} AND short", "anti_bot", "anubis", "browser"),
        (m(P.REDDIT), "block_page_detected", "reddit_interstitial", None), (m(P.BAXIA), "anti_bot", "alibaba_punish", "browser"), (m(P.CAPTCHA), "block_page_detected", "captcha_redirect", None), (m(P.VHOST), "block_page_detected", "default_vhost_page", None),
        (f"short AND {m(P.CF)}", "block_page_detected", "cf_iuam", "tls_impersonate"), (f"short AND {m(P.BLOCK)}", "block_page_detected", None, None), (f"short AND {m(P.SCRIPT)} AND {m(P.SHELL)}", "length_floor", "js_required", "browser"),
        (f"short AND length({_VISIBLE.format('html')}) < 32 AND NOT {m(P.LD_JSON)}", "blank_page", None, "browser"), (f"short AND ({m(P.EMPTY, 'md')} OR {m(P.EMPTY)})", "length_floor", "empty_result", None), ("short", "length_floor", "thin_fallthrough", None),
    ]
    case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {_q(r[k]) if r[k] else 'NULL'}" for r in rungs)
    return f"SELECT {key}, md, {case(1)} ELSE 'ok' END AS verdict, {case(2)} END AS subsystem, {case(3)} END AS next_tier FROM (SELECT *, length(md) < 500 AS short FROM {pages})"


@query(f"SELECT page_id, verdict, subsystem, next_tier FROM ({gate_sql(f'(SELECT page_id, html, {_VISIBLE.format("html")} AS md, NULL AS content_type FROM pages)', 'page_id')})")
def gat_page_gate(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", gate(visible_text(html), html, F.lit("text/html")).alias("g")).select("page_id", "g.*")


@query(f"SELECT page_id, {_HOST.format('url')} AS host, {_SITE.format('url')} AS site, {_NORM.format('url')} AS target, regexp_matches(url, '^[^?#]*\\?[^#]') OR regexp_matches(url, '(?i)^[^?#]*/(search|arama|ara|results|sr|find|query)(/|$|[?#])') AS search_shaped FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", links.host(url).alias("host"), links.site(url).alias("site"), links.normalised(url).alias("target"), links.search_shaped(url).alias("search_shaped"))


_LOG = "SELECT user_id AS fetch_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'gate_outcome' ELSE 'tier_outcome' END AS kind, CASE event_id % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'paywall' WHEN 2 THEN 'timeout' WHEN 3 THEN 'anti_bot' WHEN 4 THEN 'length_floor' WHEN 5 THEN 'rate_limited' ELSE CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'other' END END AS verdict, event_id % 5 = 0 AS authoritative FROM events"


def _log(spark, sf_dir) -> DataFrame:
    return spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


_RANKS = "map {" + ", ".join(f"'{k}': {v}" for k, v in P.VERDICT_RANK.items()) + "}"


def resolve_sql(log: str) -> str:
    """SQL over a log: the facts by which a fetch resolves, and its verdict."""
    best = lambda on: f"arg_max(verdict, authoritative::int * 100 + ({_RANKS})[verdict]) FILTER (WHERE authoritative OR ({on}))"
    return f"""SELECT *, coalesce(CASE WHEN gate_ok OR (tier_ok AND NOT gated) THEN 'ok' WHEN tier_ok THEN by_gate ELSE by_tier END, 'other') AS verdict FROM (
        SELECT fetch_id, bool_or(kind = 'gate_outcome' AND verdict = 'ok') AS gate_ok, bool_or(kind = 'tier_outcome' AND verdict = 'ok') AS tier_ok, bool_or(kind = 'gate_outcome') AS gated,
        {best("kind = 'gate_outcome'")} AS by_gate, {best("kind = 'tier_outcome' AND verdict <> 'ok'")} AS by_tier, count(*) AS observations FROM {log} GROUP BY fetch_id)"""


@query(f"SELECT fetch_id, verdict, observations FROM ({resolve_sql(f'({_LOG})')})")
def agg1_resolve_verdicts(spark, sf_dir):
    return log.resolve_verdicts(_log(spark, sf_dir))


@query("""
    WITH e AS (SELECT user_id AS key, event_id AS seq, event_id % 3 <> 0 AND value < 80 AS failed FROM events),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS island FROM e),
    r AS (SELECT key, island, count(*) AS n FROM i WHERE failed GROUP BY ALL)
    SELECT key, max(n) AS longest_run, count(*) FILTER (WHERE n >= 3) AS opened FROM r GROUP BY key
""")
def s4_proxy_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), ((F.col("event_id") % 3 != 0) & (F.col("value") < 80)).alias("failed"))
    return log.failure_runs(e, 3)


@query("""
    SELECT s.event_id AS id, s.user_id AS target, s.ts, min(v.ts) AS followed_at FROM (SELECT * FROM events WHERE event_id % 10 = 0) s
    LEFT JOIN (SELECT * FROM events WHERE event_id % 10 <> 0) v ON s.user_id = v.user_id AND v.ts > s.ts GROUP BY ALL
""")
def jon5_uptake(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("event_id % 10 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), "ts")
    return log.first_visit_after(s, e.where("event_id % 10 <> 0").select(F.col("user_id").alias("target"), "ts"))


@query("""
    WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts) AS k FROM e)
    SELECT key, min(ts) AS started, count(*) AS n FROM s GROUP BY key, k
""")
def win9_sessions(spark, sf_dir):
    return log.sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), "6 hours")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL")
def s8_latency_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).select("event_type", F.col("w.start").alias("started"), "n", "mean", "most")


_F1 = r"""
    p AS (SELECT b.item_id AS slug, d.text AS extracted, b.text AS gold FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    t AS (SELECT slug, list_filter(regexp_split_to_array(lower(extracted), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS e, list_filter(regexp_split_to_array(lower(gold), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS g FROM p),
    ce AS (SELECT slug, w, count(*) AS n FROM (SELECT slug, unnest(e) AS w FROM t) GROUP BY ALL), cg AS (SELECT slug, w, count(*) AS n FROM (SELECT slug, unnest(g) AS w FROM t) GROUP BY ALL),
    c AS (SELECT slug, sum(least(ce.n, cg.n))::BIGINT AS common FROM ce JOIN cg USING (slug, w) GROUP BY slug),
    f AS (SELECT slug, len(e) AS n_extracted, len(g) AS n_gold, coalesce(common, 0) AS common, round(CASE WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * common / (len(e) + len(g)) END::DOUBLE, 9) AS f1 FROM t LEFT JOIN c USING (slug))
"""


def _f1(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("extracted"))
    return scores.token_f1(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slug"), F.col("text").alias("gold")).join(d, "slug"))


@query(f"WITH {_F1} SELECT slug, n_extracted, n_gold, common, f1 FROM f")
def agg11_token_f1(spark, sf_dir):
    return _f1(spark, sf_dir).select("slug", "n_extracted", "n_gold", "common", "f1")


@query(f"""WITH {_F1}, k AS (SELECT slug % 3 AS class, f1, row_number() OVER (PARTITION BY slug % 3 ORDER BY f1) AS k, count(*) OVER (PARTITION BY slug % 3) AS n FROM f)
    SELECT class, max(n) AS n, round(avg(f1), 9) AS mean, max(f1) FILTER (WHERE k = n // 2 + 1) AS upper_median, max(f1) FILTER (WHERE k = greatest(0, n // 10 - 1) + 1) AS p10, count(*) FILTER (WHERE f1 < 0.1) AS below FROM k GROUP BY class""")
def agg13_extraction_summary(spark, sf_dir):
    return scores.summary(_f1(spark, sf_dir).select((F.col("slug") % 3).alias("class"), "f1"), "class", "f1", 0.1)


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)::INT) END AS tokens FROM documents")
def agg25_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scores.token_estimate(F.col("text")).alias("tokens"))


_ROWS = "SELECT doc_id % 50 AS slug, source AS system, lang AS class, n_chars % 6 AS overall FROM documents"


@query(f"SELECT system, count(*) AS n, count(*) FILTER (WHERE overall >= 3) AS reached, round(avg(overall), 6) AS mean, median(overall) AS median, min(overall) AS least, max(overall) AS most FROM ({_ROWS}) GROUP BY system")
def agg17_leaderboard(spark, sf_dir):
    rows = spark.sql(_ROWS.replace("documents", "{d}"), d=table(spark, sf_dir, "documents"))
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("overall") >= 3).alias("reached"), F.round(F.avg("overall"), 6).alias("mean"), F.median("overall").alias("median"), F.min("overall").alias("least"), F.max("overall").alias("most"))


@query(f"SELECT system, class, count(*) AS n, round(sum(overall * 0.25), 6) AS total, round(avg(overall), 6) AS mean FROM ({_ROWS}) GROUP BY ROLLUP (system, class)")
def agg20_cost_rollup(spark, sf_dir):
    rows = spark.sql(_ROWS.replace("documents", "{d}"), d=table(spark, sf_dir, "documents"))
    return rows.rollup("system", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("overall") * 0.25), 6).alias("total"), F.round(F.avg("overall"), 6).alias("mean"))


@query(f"WITH m AS (SELECT slug, system, max(overall) AS overall FROM ({_ROWS}) GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY slug ORDER BY overall DESC) AS k FROM m) SELECT system, count(*) AS wins FROM r WHERE k = 1 GROUP BY system")
def win4_wins_with_ties(spark, sf_dir):
    rows = spark.sql(_ROWS.replace("documents", "{d}"), d=table(spark, sf_dir, "documents"))
    return scores.wins(rows.groupBy("slug", "system").agg(F.max("overall").alias("overall")))


@query("""
    WITH c AS (SELECT 'toxic' AS axis, source AS system, CASE WHEN l.toxic IS NULL THEN 'unscored' WHEN d.lang = 'de' THEN 'not_applicable' ELSE 'scored' END AS disposition FROM documents d LEFT JOIN labels l USING (doc_id)),
    g AS (SELECT axis, system, count(*) FILTER (WHERE disposition = 'scored') AS scored, count(*) FILTER (WHERE disposition = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE disposition = 'unscored') AS unscored FROM c GROUP BY ALL)
    SELECT *, scored + unscored AS requested, scored + unscored >= 1 AND scored = 0 AS broken, scored > 0 AND scored < 0.9 * (scored + unscored) AS thin FROM g
""")
def agg14_axis_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("system")).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    disposition = F.when(F.col("toxic").isNull(), "unscored").when(F.col("lang") == "de", "not_applicable").otherwise("scored")
    return scores.coverage(d.select(F.lit("toxic").alias("axis"), "system", disposition.alias("disposition")))


@query(r"SELECT conv_id, string_agg(turn || chr(9) || role || chr(9) || replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(10) ORDER BY turn, role, text) AS tsv FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id")
def snk1_tsv(spark, sf_dir):
    esc = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    rows = table(spark, sf_dir, "conversations").where("text is not null and role is not null").select("conv_id", F.struct("turn", "role", "text", F.concat_ws("\t", F.col("turn").cast("string"), "role", esc).alias("line")).alias("r"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("tsv"))


@query("SELECT e.event_id, CASE WHEN e.value < 20 THEN 300 WHEN e.value < 60 THEN 86400 ELSE 604800 END AS ttl, e.ts - lag(e.ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= CASE WHEN e.value < 20 THEN INTERVAL 300 SECOND WHEN e.value < 60 THEN INTERVAL 86400 SECOND ELSE INTERVAL 604800 SECOND END AS hit FROM events e")
def jon9_cache_hits(spark, sf_dir):
    from pyspark.sql import Window

    ttl = F.when(F.col("value") < 20, 300).when(F.col("value") < 60, 86400).otherwise(604800)
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", ttl.alias("ttl"), (gap <= F.make_dt_interval(secs=ttl)).alias("hit"))
