"""Registered queries over written-out pages that reach every rung of the gate and every overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.functions import gate as G
from siftpage.functions import patterns as P
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import _VISIBLE, _q, gate_sql, query

_LONG, _TEXT = "word " * 130, "<p>" + "Some words that a reader can see on this page. " * 3 + "</p>"
# (md, html, content type, tier, host, is_json, structured)
_PAGES = [
    ("short", _TEXT, "application/pdf", "raw", "a.com", False, False),
    ("short", _TEXT, "", "raw", "a.com", False, False),
    (_LONG, '<div class="cf-turnstile"></div>', "text/html", "raw", "a.com", False, False),
    (_LONG, '<div class="cf-turnstile"></div>', "text/html", "raw", "a.com", False, True),
    ("short", '<div class="cf-turnstile"></div>', None, "raw", "a.com", False, True),
    (_LONG, "document.cookie='_abck=1'", "text/html; charset=utf-8", "raw", "a.com", False, False),
    (_LONG, "document.cookie='_abck=1'", "text/html", "raw", "a.com", False, True),
    ("short", "<img alt=Anubis>" + _TEXT, None, "raw", "a.com", False, True),
    (_LONG, "<img alt=Anubis>" + _TEXT, None, "raw", "a.com", False, False),
    (_LONG, "Whoa there, pardner!", None, "raw", "a.com", False, False),
    (_LONG, "window._____tmd_____", None, "raw", "a.com", False, True),
    (_LONG, "<title>Bing</title>\n one more\n captcha", None, "raw", "a.com", False, False),
    (_LONG, "<h1>Welcome to nginx!</h1>", None, "raw", "a.com", False, False),
    ("short", "<h1>Just a moment</h1>" + _TEXT, None, "raw", "a.com", False, False),
    (_LONG, "<h1>Just a moment</h1>" + _TEXT, None, "raw", "a.com", False, False),
    ("short", "<h1>Access denied</h1>" + _TEXT, None, "raw", "a.com", False, False),
    ("short", "<b>_incapsula_</b>" + _TEXT, None, "raw", "a.com", False, False),
    ("short", "<b>_Incapsula_</b>" + _TEXT, None, "raw", "a.com", False, False),
    ("short", '<script>x()</script><div id="root"></div>' + _TEXT, None, "raw", "a.com", False, True),
    ("short", "<script>x()</script><My-App></My-App>" + _TEXT, None, "raw", "a.com", False, False),
    ("short", "<script>var a = '" + "z" * 90 + "';</script><p>few</p>", None, "raw", "a.com", False, False),
    ("short", "<script type='application/ld+json'>{}</script><p>few</p>", None, "raw", "a.com", False, True),
    ("short", "<style>p {}</style><STYLE >b</STYLE><p>few</p>", None, "raw", "a.com", True, False),
    ("No results for this", _TEXT, None, "raw", "a.com", False, True),
    ("short", _TEXT + "<p>Ürün bulunamadı</p>", None, "raw", "a.com", False, False),
    ("short", _TEXT, None, "raw", "a.com", False, False),
    ("short", _TEXT, None, "raw", "a.com", True, False),
    ("short", _TEXT, None, "raw", "a.com", False, True),
    ("  " + "y" * 499, _TEXT, None, "raw", "a.com", False, False),
    (_LONG, _TEXT, None, "raw", "a.com", False, False),
    (_LONG, _TEXT, None, "browser", "WWW.X.com", False, False),
    ("short", _TEXT, None, "browser", "tiktok.com", False, True),
    ("short", _TEXT, None, "browser", "tiktok.com", True, False),
    (_LONG * 3, _TEXT, None, "browser", "x.com", False, False),
    (_LONG, _TEXT, None, "browser", None, False, False),
    (_LONG, '<script src=a></script><div data-reactroot></div>', None, "raw", "a.com", False, False),
    (_LONG, '<script src=a></script><noscript>n</noscript>', None, "raw", "a.com", False, False),
    ("", "", None, "raw", "a.com", False, False),
]
PAGES = Fixture("pages: id int, md string, html string, content_type string, tier string, host string, is_json boolean, structured boolean", [(i, *p) for i, p in enumerate(_PAGES)])


@query(f"SELECT id, verdict, subsystem, next_tier FROM ({gate_sql(PAGES.sql, 'id')})")
def gat1_gat15_every_rung(spark, sf_dir):
    return PAGES.df(spark, sf_dir).select("id", G.gate(F.col("md"), F.col("html"), F.col("content_type")).alias("g")).select("id", "g.*")


_HEAVY = ", ".join(f"'{h}'" for h in P.JS_HEAVY)


@query(f"""
    WITH g AS (SELECT p.id, p.md, tier, host, is_json, structured, verdict, subsystem, next_tier FROM {PAGES.sql} p JOIN ({gate_sql(PAGES.sql, 'id')}) USING (id)),
    a AS (SELECT * REPLACE (CASE WHEN thin THEN 'length_floor' ELSE verdict END AS verdict, CASE WHEN thin THEN 'thin_browser_response' ELSE subsystem END AS subsystem) FROM (SELECT *, coalesce(tier = 'browser' AND length(md) < 1024 AND verdict IN ('ok', 'length_floor') AND regexp_replace(lower(host), '^www\\.', '') IN ({_HEAVY}), false) AS thin FROM g)),
    b AS (SELECT *, CASE WHEN is_json AND verdict IN ('length_floor', 'blank_page') THEN 'json' WHEN structured AND verdict = 'length_floor' AND coalesce(subsystem, 'thin_fallthrough') = 'thin_fallthrough' THEN 'bare' WHEN structured AND verdict = 'anti_bot' AND subsystem IN ('akamai_bmp', 'turnstile') AND length(md) >= 500 THEN 'marked' END AS lift FROM a)
    SELECT id, CASE WHEN lift IS NULL THEN verdict ELSE 'ok' END AS verdict, CASE WHEN lift IS NULL THEN subsystem END AS subsystem, CASE WHEN lift IS NULL OR lift = 'bare' THEN next_tier END AS next_tier, coalesce(lift IN ('bare', 'marked'), false) AS promoted FROM b
""")
def gat16_gat19_overlays(spark, sf_dir):
    p = PAGES.df(spark, sf_dir).withColumn("g", G.gate(F.col("md"), F.col("html"), F.col("content_type")))
    over = G.overlaid(F.col("g"), F.col("md"), F.col("tier"), F.col("host"), F.col("is_json"), F.col("structured"), P.JS_HEAVY)
    return p.select("id", over.alias("o")).select("id", "o.*")


@query(f"""
    SELECT r.id, r.verdict AS regated, r.subsystem, c.challenge FROM ({gate_sql(f'(SELECT id, html AS md, html, NULL AS content_type FROM {PAGES.sql})', 'id')}) r
    JOIN (SELECT id, CASE WHEN verdict IN ('anti_bot', 'block_page_detected') THEN verdict END AS challenge FROM ({gate_sql(f'(SELECT id, md, html, NULL AS content_type FROM {PAGES.sql})', 'id')})) c USING (id)
""")
def gat20_gat21_regate_and_challenge(spark, sf_dir):
    p = PAGES.df(spark, sf_dir).select("id", G.regate(F.col("html")).alias("r"), G.challenge(F.col("md"), F.col("html")).alias("c"))
    return p.select("id", F.col("r.verdict").alias("regated"), "r.subsystem", F.col("c.verdict").alias("challenge"))


@query(f"SELECT id, regexp_matches(html, {_q(P.SCRIPT)}) AND regexp_matches(html, {_q(P.SPA_MOUNT)}) AS shell, length({_VISIBLE.format('html')}) AS visible FROM {PAGES.sql}")
def flt3_unrendered_shell(spark, sf_dir):
    return PAGES.df(spark, sf_dir).select("id", G.unrendered_shell(F.col("html")).alias("shell"), F.length(G.visible_text(F.col("html"))).alias("visible"))


@query(f"SELECT host, host IN ('x.com', 'shop.example', {_HEAVY}) AS js_heavy FROM (SELECT DISTINCT regexp_replace(lower(host), '^www\\.', '') AS host FROM {PAGES.sql} WHERE host IS NOT NULL UNION SELECT 'shop.example')")
def flt4_set4_js_heavy_hosts(spark, sf_dir):
    """The seed and the operator's extras, trimmed and in lower case, are one set."""
    extras = spark.createDataFrame([(" Shop.Example ",), ("",), ("x.com",)], "host string").select(F.lower(F.trim("host")).alias("host")).where("host <> ''")
    heavy = spark.createDataFrame([(h,) for h in P.JS_HEAVY], "host string").union(extras).distinct().withColumn("js_heavy", F.lit(True))
    seen = PAGES.df(spark, sf_dir).where("host is not null").select(F.regexp_replace(F.lower("host"), r"^www\.", "").alias("host")).union(spark.createDataFrame([("shop.example",)], "host string")).distinct()
    return seen.join(F.broadcast(heavy), "host", "left").select("host", F.coalesce("js_heavy", F.lit(False)).alias("js_heavy"))
