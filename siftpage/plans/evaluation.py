"""Registered queries over evaluation rows: run noise, pivots, deltas, reasons, bake-off, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.functions.gate import gate, visible_text
from siftpage.functions.scalars import confidence, read_again, read_flags
from siftpage.functions.texts import capped_confidence
from siftpage.operators.links import served_elsewhere
from siftpage.operators.scores import token_breakdown
from siftpage.plans.queries import _F1, _ROWS, _SITE, _VISIBLE, _f1, gate_sql, query, table
from siftpage.plans.retrieval import rows

_LANGS = ["de", "en", "es", "fr"]


@query(f"WITH {_F1} SELECT slug, round(CASE WHEN length(p.gold) = 0 THEN 0.0 ELSE length(p.extracted) / length(p.gold) END, 9) AS ratio FROM p")
def agg12_length_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.length("text").alias("extracted"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slug"), F.length("text").alias("gold"))
    return b.join(d, "slug").select("slug", F.round(F.when(F.col("gold") == 0, 0.0).otherwise(F.col("extracted") / F.col("gold")), 9).alias("ratio"))


_A = "SELECT doc_id AS slug, source AS system, n_chars % 6 AS score FROM documents"
_B = "SELECT doc_id AS slug, source AS system, (n_chars + doc_id % 3) % 6 AS score FROM documents"


@query(f"""
    WITH d AS (SELECT system, abs(a.score - b.score) AS d FROM ({_A}) a JOIN ({_B}) b USING (slug, system))
    SELECT system, count(*) AS cells, count(*) FILTER (WHERE d = 0) AS identical, round(avg(d), 9) AS mean, quantile_disc(d, 0.9) AS p90, max(d) AS most FROM d GROUP BY system
""")
def agg31_run_noise(spark, sf_dir):
    b = rows(spark, sf_dir, _B, "documents").withColumnRenamed("score", "again")
    d = rows(spark, sf_dir, _A, "documents").join(b, ["slug", "system"]).select("system", F.abs(F.col("score") - F.col("again")).alias("d"))
    return d.groupBy("system").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("d") == 0).alias("identical"), F.round(F.avg("d"), 9).alias("mean"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY d)").alias("p90"), F.max("d").alias("most"))


@query("SELECT system, " + ", ".join(f"round(avg(overall) FILTER (WHERE class = '{x}'), 9) AS {x}" for x in _LANGS) + f" FROM ({_ROWS}) GROUP BY system")
def agg18_class_pivot(spark, sf_dir):
    return rows(spark, sf_dir, _ROWS, "documents").groupBy("system").pivot("class", _LANGS).agg(F.round(F.avg("overall"), 9))


@query(f"WITH m AS (SELECT system, class, avg(overall) AS mean FROM ({_ROWS}) GROUP BY ALL), b AS (SELECT class, mean AS base FROM m WHERE system = 'src1') SELECT system, class, round(mean, 9) AS mean, round(mean - base, 9) AS delta FROM m JOIN b USING (class)")
def agg19_delta_to_baseline(spark, sf_dir):
    m = rows(spark, sf_dir, _ROWS, "documents").groupBy("system", "class").agg(F.avg("overall").alias("mean"))
    base = m.where("system = 'src1'").select("class", F.col("mean").alias("base"))  # the declared baseline
    return m.join(base, "class").select("system", "class", F.round("mean", 9).alias("mean"), F.round(F.col("mean") - F.col("base"), 9).alias("delta"))


@query("SELECT source AS system, CASE WHEN text IS NULL OR length(text) < 500 THEN 'thin_body' ELSE 'no_judge' END AS reason, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL) GROUP BY ALL")
def agg22_unscored_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id"), "doc_id", "left_anti")
    reason = F.when(F.col("text").isNull() | (F.length("text") < 500), "thin_body").otherwise("no_judge")
    return d.groupBy(F.col("source").alias("system"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# A page as each of three backends saw it: rendered by the page's number, with the verdict of the gate over its visible text.
_MARKDOWN = "(SELECT page_id, html, " + _VISIBLE.format("html") + " AS md, 'text/html' AS content_type FROM pages)"


@query(f"""
    SELECT 'b' || page_id % 3 AS backend, count(*) FILTER (WHERE rendered AND verdict = 'ok' AND length(md) >= 500) AS read_ok, count(*) FILTER (WHERE rendered AND verdict NOT IN ('anti_bot', 'block_page_detected')) AS survived, coalesce(trunc(median(wall) FILTER (WHERE rendered)), 0)::INT AS median_wall
    FROM (SELECT *, page_id % 11 <> 0 AS rendered, (page_id * 37 % 9000)::DOUBLE AS wall FROM ({gate_sql(_MARKDOWN, 'page_id')})) GROUP BY ALL
""")
def flt12_agg24_bakeoff(spark, sf_dir):
    """Flags of each cell from the gate, then per backend: pages read, pages not blocked, the median wall time of those rendered."""
    html, rendered = F.col("html"), F.col("page_id") % 11 != 0
    cells = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("b"), F.col("page_id") % 3).alias("backend"), rendered.alias("rendered"), (F.col("page_id") * 37 % 9000).alias("wall"), visible_text(html).alias("md"), "html")
    cells = cells.select("backend", "rendered", "wall", F.length("md").alias("chars"), gate(F.col("md"), html, F.lit("text/html"))["verdict"].alias("verdict"))
    read_ok, survived = read_flags(F.col("rendered"), F.col("verdict"), F.col("chars"))
    wall = F.coalesce(F.median(F.when(F.col("rendered"), F.col("wall"))), F.lit(0)).cast("int")
    return cells.groupBy("backend").agg(F.count_if(read_ok).alias("read_ok"), F.count_if(survived).alias("survived"), wall.alias("median_wall"))


@query(r"SELECT doc_id, greatest(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))) - 1, 0)::INT AS candidates FROM documents WHERE text IS NOT NULL")
def agg34_tsv_candidates(spark, sf_dir):
    filled = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t\r]"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.greatest(F.size(filled) - 1, F.lit(0)).alias("candidates"))


@query(f"WITH s AS (SELECT unnest(['baseline', 'detail', 'extract']) AS system, unnest([0, 1, 2]) AS k) SELECT item_id AS slug, system, d.n_chars % 6 AS score FROM benchmark CROSS JOIN s LEFT JOIN documents d ON d.doc_id = item_id * 3 + k")
def jon13_jon14_matrix(spark, sf_dir):
    systems = spark.createDataFrame([("baseline", 0), ("detail", 1), ("extract", 2)], "system string, k long")
    cells = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slug")).crossJoin(F.broadcast(systems)).withColumn("doc_id", F.col("slug") * 3 + F.col("k"))
    scored = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 6).alias("score"))
    return cells.join(scored, "doc_id", "left").select("slug", "system", "score")


@query("SELECT coalesce(d.lang, x.lang) AS lang, CASE WHEN d.lang IS NULL THEN 'missing' ELSE 'undeclared' END AS fault FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) d FULL JOIN (SELECT unnest(['en', 'de', 'xx']) AS lang) x ON d.lang = x.lang WHERE d.lang IS NULL OR x.lang IS NULL")
def set5_registry_diff(spark, sf_dir):
    declared = spark.createDataFrame([("en",), ("de",), ("xx",)], "lang string").withColumn("declared", F.lit(True))
    used = table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().withColumn("used", F.lit(True))
    both = used.join(declared, "lang", "full").where("used is null or declared is null")
    return both.select("lang", F.when(F.col("used").isNull(), "missing").otherwise("undeclared").alias("fault"))


_ENVELOPE = """SELECT doc_id, concat('{"answer":"', lang, ' ', source, '","n":', doc_id, ',"none":null,"pages":[{"url":"u","kind":"k"},{"url":"', source, '"}],"debug":{"tier":"raw","steps":["a","b"]},"empty":""}') AS envelope FROM documents"""


@query("""
    WITH d AS (SELECT doc_id, length(lang) + length(source) + 1 AS answer, length(doc_id::VARCHAR) AS n, length('[{"url": "u", "kind": "k"}, {"url": ""}]') + length(source) AS pages, length('{"tier": "raw", "steps": ["a", "b"]}') AS debug FROM documents),
    f AS (SELECT doc_id, unnest([{'field': 'answer', 'chars': answer}, {'field': 'n', 'chars': n}, {'field': 'none', 'chars': 4}, {'field': 'pages', 'chars': pages}, {'field': 'debug', 'chars': debug}, {'field': 'debug.tier', 'chars': 3}, {'field': 'debug.steps', 'chars': 10}, {'field': 'empty', 'chars': 0},
        {'field': 'total', 'chars': length('{"answer": "", "n": , "none": null, "pages": , "debug": , "empty": ""}') + answer + n + pages + debug}], recursive := true) FROM d)
    SELECT doc_id, field, CASE WHEN chars = 0 THEN 0 ELSE greatest(1, round_even(chars / 4, 0)) END::INT AS tokens FROM f
""")
def agg25_token_breakdown(spark, sf_dir):
    return token_breakdown(rows(spark, sf_dir, _ENVELOPE, "documents").select(F.col("doc_id").alias("id"), "envelope")).withColumnRenamed("id", "doc_id")


@query(f"""
    WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.elsewhere.org/x' WHEN 2 THEN replace(url, '://', '://m.') ELSE '' END AS served, page_id * 53 % 4000 AS chars FROM pages),
    d AS (SELECT *, served <> '' AND {_SITE.format('url')} <> {_SITE.format('served')} AS differs FROM p)
    SELECT page_id, differs, CASE WHEN chars > 2000 AND NOT differs THEN 'high' ELSE 'medium' END AS confidence FROM d
""")
def pln24_served_elsewhere(spark, sf_dir):
    served = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, "https://www.elsewhere.org/x").when(F.col("page_id") % 4 == 2, F.replace(F.col("url"), F.lit("://"), F.lit("://m."))).otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", served_elsewhere(F.col("url"), served).alias("differs"), F.repeat(F.lit("x"), (F.col("page_id") * 53 % 4000).cast("int")).alias("body"))
    return p.select("page_id", "differs", capped_confidence(confidence(F.lit("ok"), F.col("body")), F.col("differs")).alias("confidence"))


@query("""
    SELECT page_id, length(html) > 0 AND page_id % 4 IN (0, 1) AS read FROM pages
""")
def flt11_read_again(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["text/html", "application/xhtml+xml; html", "text/markdown", "application/json"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", read_again(F.col("html"), kind).alias("read"))
