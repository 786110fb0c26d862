"""Registered queries over requests, observations and answers; small inputs are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions import scalars as S
from siftpage.operators import links, routing
from siftpage.plans.queries import _HOST, _q, query, table

_PATH = r"regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


def rows(spark, sf_dir: str, sql: str, name: str) -> DataFrame:
    """sql, which both engines read, over one of the given tables."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


_STATUS = "SELECT event_id, 200 + event_id * 7 % 400 AS status, CASE event_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/ld+json' ELSE 'application/pdf' END AS content_type FROM events"


@query(f"""
    SELECT event_id, CASE WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 400 THEN 'connection_error' WHEN content_type LIKE '%json%' OR content_type LIKE '%html%' THEN 'ok' ELSE 'content_type_mismatch' END AS raw,
    CASE WHEN status IN (401, 402, 403) THEN 'paid_auth_error' WHEN status = 429 THEN 'rate_limited' WHEN status = 404 THEN 'not_found' WHEN status >= 400 THEN 'connection_error' ELSE 'ok' END AS paid FROM ({_STATUS})
""")
def src6_src11_status_verdicts(spark, sf_dir):
    s = rows(spark, sf_dir, _STATUS, "events")
    return s.select("event_id", S.raw_verdict(F.col("status"), F.col("content_type")).alias("raw"), S.paid_verdict(F.col("status")).alias("paid"))


_AGES = "SELECT event_id, event_id * event_id * 37 % 400000007 - 5 AS age FROM events"


@query(f"""
    SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' WHEN s < 31536000 THEN s // 86400 || 'd' ELSE s // 31536000 || 'y' END AS age
    FROM (SELECT event_id, greatest(age, 0) AS s FROM ({_AGES}))
""")
def dat1_human_age(spark, sf_dir):
    return rows(spark, sf_dir, _AGES, "events").select("event_id", S.human_age(F.col("age")).alias("age"))


_LISTINGS = """SELECT page_id, concat(html, CASE page_id % 4 WHEN 0 THEN concat('<p>', page_id, ',012 results, page of 24 items</p>') WHEN 1 THEN concat('{"numberOfItems": "', page_id, '"} 9999 products') ELSE '' END) AS html FROM pages"""


@query(f"""
    SELECT page_id, coalesce(TRY_CAST(regexp_replace(regexp_extract(html, {_q(S.ITEMS)}, 1), '[.,]', '', 'g') AS BIGINT), list_max(list_transform(regexp_extract_all(html, {_q(S.SHOWN)}, 1), lambda x: TRY_CAST(regexp_replace(x, '[.,]', '', 'g') AS BIGINT)))) AS total FROM ({_LISTINGS})
""")
def agg7_listing_oracle(spark, sf_dir):
    return rows(spark, sf_dir, _LISTINGS, "pages").select("page_id", S.listing_total(F.col("html")).alias("total"))


_LOADED = "SELECT conv_id, count(CASE WHEN role = 'assistant' THEN 1 END) AS loaded, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE count(*) - conv_id % 3 END AS total FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, loaded, total, CASE WHEN total IS NULL THEN 'ready' WHEN total > 0 AND loaded = 0 THEN 'fail' WHEN loaded >= total * 0.5 THEN 'ready' ELSE 'partial' END AS readiness FROM ({_LOADED})")
def agg8_listing_readiness(spark, sf_dir):
    return rows(spark, sf_dir, _LOADED, "conversations").withColumn("readiness", S.readiness(F.col("loaded"), F.col("total"), 0.5))


_FETCHED = "SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'paywall' ELSE 'ok' END AS verdict FROM documents"


@query(f"SELECT doc_id, CASE WHEN verdict <> 'ok' THEN 'low' WHEN length(text) > 2000 THEN 'high' ELSE 'medium' END AS confidence FROM ({_FETCHED})")
def mth1_confidence(spark, sf_dir):
    return rows(spark, sf_dir, _FETCHED, "documents").select("doc_id", S.confidence(F.col("verdict"), F.col("text")).alias("confidence"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || chr(10) || '[Content truncated to 1000 chars]' || chr(10) ELSE text END) AS body_md5, length(text) > 1000 AS truncated FROM documents")
def prj7_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.truncated(F.col("text"), 1000)).alias("body_md5"), (F.length("text") > 1000).alias("truncated"))


_WRAPPED = "SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'https://r.jina.ai/' WHEN 1 THEN 'r.jina.ai/' WHEN 2 THEN 'https://r.jina.ai/x' ELSE '' END, url) AS url FROM pages"


@query(rf"SELECT page_id, nullif(regexp_extract(url, '^(?:https?://)?r\.jina\.ai/(https?://.*)$', 1), '') AS target FROM ({_WRAPPED})")
def url5_reader_unwrap(spark, sf_dir):
    return rows(spark, sf_dir, _WRAPPED, "pages").select("page_id", S.unwrapped(F.col("url")).alias("target"))


_LABELS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('Reviews and notes (', page_id, ')') WHEN 1 THEN concat('Questions  ', page_id) ELSE concat('Tab', page_id) END AS label FROM pages"


@query(rf"SELECT page_id, coalesce(nullif(regexp_extract(label, '^(.*\S)\s+\(?([0-9]+)\)?$', 1), ''), label) AS label, TRY_CAST(regexp_extract(label, '^(.*\S)\s+\(?([0-9]+)\)?$', 2) AS BIGINT) AS n FROM ({_LABELS})")
def str5_label_count(spark, sf_dir):
    part = lambda k: F.nullif(F.regexp_extract("label", S.LABEL_COUNT, k), F.lit(""))
    return rows(spark, sf_dir, _LABELS, "pages").select("page_id", F.coalesce(part(1), F.col("label")).alias("label"), part(2).cast("long").alias("n"))


@query(r"""
    WITH o AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER w AS pos, least(50, count(*) OVER (PARTITION BY conv_id)) AS n FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    c AS (SELECT *, greatest(60, least(240, 4000 // n)) AS cap FROM o WHERE pos <= 50)
    SELECT conv_id, pos::INT AS pos, CASE WHEN length(t) > cap THEN rtrim(left(t, cap - 1)) || '…' ELSE t END AS detail FROM c
""")
def lim2_options_shelf(spark, sf_dir):
    by = Window.partitionBy("conv_id")
    o = table(spark, sf_dir, "conversations").where("text is not null").withColumn("pos", F.row_number().over(by.orderBy("turn", "role", "text"))).withColumn("n", F.least(F.lit(50), F.count(F.lit(1)).over(by)))
    return o.where("pos <= 50").select("conv_id", "pos", S.capped(S.collapsed(F.col("text")), S.detail_cap(F.col("n"))).alias("detail"))


_RULES = [(0, "*.example.com", "a"), (1, "example.net", "b"), (2, "*.org", "c"), (3, "*.NET", "d")]
_RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{p}', '{x}')" for i, p, x in _RULES) + ") r(idx, pattern, proxy)"


@query(f"""
    SELECT page_id AS id, (SELECT arg_min(proxy, idx) FROM {_RULES_SQL} WHERE lower(pattern) = host OR (pattern LIKE '*.%' AND (host = lower(pattern[3:]) OR ends_with(host, '.' || lower(pattern[3:]))))) AS proxy
    FROM (SELECT page_id, {_HOST.format("url")} AS host FROM pages)
""")
def jon6_first_route(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), links.host(F.col("url")).alias("host"))
    return routing.first_route(asked, spark.createDataFrame(_RULES, "idx int, pattern string, proxy string"))


@query("""
    WITH h AS (SELECT user_id AS proxy FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_id % 3 = 0) % 2 = 0),
    c AS (SELECT user_id AS id, unnest([user_id, user_id + 1, user_id + 7]) AS proxy, unnest([0, 1, 2]) AS pos FROM (SELECT DISTINCT user_id FROM events))
    SELECT id, arg_min(CASE WHEN h.proxy IS NOT NULL THEN c.proxy END, pos) FILTER (WHERE h.proxy IS NOT NULL) AS proxy FROM c LEFT JOIN h ON c.proxy = h.proxy GROUP BY id
""")
def jon7_first_healthy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    healthy = e.groupBy(F.col("user_id").alias("proxy")).agg((F.count_if(F.col("event_id") % 3 == 0) % 2 == 0).alias("ok")).where("ok")
    u = F.col("user_id")
    return routing.first_healthy(e.select(u).distinct().select(u.alias("id"), F.array(u, u + 1, u + 7).alias("chain")), healthy)


_COOKIES = [("s", ".example.com", "/", False, 0), ("t", "example.com", "/en", True, 0), ("u", ".org", "/en/", False, 50), ("v", ".net", "/", False, 10), ("w", ".", "/", False, 0)]
_COOKIES_SQL = "(VALUES " + ", ".join(f"('{n}', '{h}', '{p}', {s}, {e})" for n, h, p, s, e in _COOKIES) + ") c(name, host_key, under, only_secure, expires)"


@query(f"""
    SELECT id, name FROM (SELECT page_id AS id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, url LIKE 'https:%' AS secure FROM pages) q JOIN {_COOKIES_SQL}
    ON host <> '' AND (host_key = host OR (host_key LIKE '.%' AND host_key <> '.' AND (host = host_key[2:] OR ends_with(host, host_key))))
    AND (under IN ('', '/') OR path = under OR (starts_with(path, under) AND (under LIKE '%/' OR substr(path, length(under) + 1, 1) = '/')))
    AND (NOT only_secure OR secure) AND (expires = 0 OR expires > 20)
""")
def jon8_cookies(spark, sf_dir):
    url = F.col("url")
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), links.host(url).alias("host"), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"), url.startswith("https:").alias("secure"))
    return routing.cookies_for(asked, spark.createDataFrame(_COOKIES, "name string, host_key string, path string, secure boolean, expires int"), 20)


_POSTS = "SELECT DISTINCT conv_id AS thread, turn AS num, turn - turn % 3 AS reply_to FROM conversations"


@query(f"""
    WITH p AS ({_POSTS}) SELECT thread, num, CASE WHEN reply_to <> num AND EXISTS (SELECT 1 FROM p q WHERE q.thread = p.thread AND q.num = p.reply_to) THEN reply_to ELSE (SELECT min(num) FROM p q WHERE q.thread = p.thread) END AS parent FROM p
""")
def jon10_reply_parents(spark, sf_dir):
    return routing.reply_parents(rows(spark, sf_dir, _POSTS, "conversations"))


@query(r"""
    WITH c AS (SELECT conv_id AS page, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS norm, min(turn) AS ord FROM conversations GROUP BY ALL)
    SELECT page, ord FROM c WHERE norm <> '' AND NOT EXISTS (SELECT 1 FROM c d WHERE d.page = c.page AND d.norm <> c.norm AND contains(d.norm, c.norm))
""")
def ext27_subset_suppression(spark, sf_dir):
    return routing.whole_candidates(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.col("text").alias("body")))


@query("SELECT event_id, row_number() OVER t - 1 AS attempts, epoch_us(ts) - lag(epoch_us(ts)) OVER u AS gap_us FROM events WINDOW t AS (PARTITION BY user_id, event_type ORDER BY ts, event_id), u AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win5_win6_attempts_and_gaps(spark, sf_dir):
    attempts = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", attempts.alias("attempts"), F.expr("timestampdiff(MICROSECOND, before, ts)").alias("gap_us"))


@query("""
    WITH c AS (SELECT user_id, floor(value * 1000)::BIGINT AS ms, coalesce(sum(floor(value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
    SELECT user_id, count(*) FILTER (WHERE spent < 500000) AS dispatched, bool_or(spent >= 500000) AS timed_out FROM c GROUP BY user_id
""")
def pln16_deadline(spark, sf_dir):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.floor(F.col("value") * 1000)).over(before), F.lit(0))
    e = table(spark, sf_dir, "events").select("user_id", spent.alias("spent"))
    return e.groupBy("user_id").agg(F.count_if(F.col("spent") < 500000).alias("dispatched"), F.bool_or(F.col("spent") >= 500000).alias("timed_out"))


# Declared: who may claim the one paid dispatch of a fetch, in order.
_CLAIMANTS = ["signup", "purchase", "error", "view", "click"]


@query(f"SELECT user_id, arg_min(event_type, (coalesce(list_position({_CLAIMANTS}, event_type), 99), event_id)) AS claimant, count(*) - 1 AS refused FROM events GROUP BY user_id")
def pln13_paid_budget(spark, sf_dir):
    """The first claimant by the declared order, and by time among its own claims, gets the dispatch."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _CLAIMANTS)), F.col("event_type")), F.lit(0)), F.lit(99))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(order, "event_id")).alias("claimant"), (F.count(F.lit(1)) - 1).alias("refused"))
