"""Registered queries over links: resolution, digests and the lists made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import links as L
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import _q, query, table

# One page's links, one row each: page_id, url of the page, place, href, label.
_BASES = ["https://x.com/a/b/page?q=1#top", "https://www.shop.example.com", "http://h.net:8080/d/"]
_HREFS = ["c", "../d", "//y.com/z", "/r/./s/../t", "?p=2", "#frag", "", "  ", "mailto:a@b.c", "TEL:+12", "javascript:void(0)", "data:x,y", "https://x.com/a/b/page/?q=1", "HTTP://Other.org/Path/#f", "ftp://f.com/x", "./", "..", "../../../../up", "e//f", "/e//f", "/a//b/../c//", "/", "c/?k=v#z", "c", "https://a.shop.example.com/i", "https://example.com/j", "page", "blob:1", "about:blank", "http://h.net/d"]
HREFS = Fixture("pages/8: page_id int, url string, pos int, href string, label string", [(p, b, i, h, ["First §", "", "Second", "First §"][(i + p) % 4]) for p, b in enumerate(_BASES) for i, h in enumerate(_HREFS)])

_NETLOC = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATHQ = "regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"
_HOSTNAME = f"regexp_replace(regexp_replace(lower({_NETLOC}), '^.*@', ''), ':[0-9]*$', '')"
_SITE = rf"array_to_string(list_slice(string_split(regexp_replace(lower({_NETLOC}), '^www\.', ''), '.'), -2, -1), '.')"
_KEY = rf"lower(regexp_extract({{0}}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || {_NETLOC} || CASE WHEN regexp_replace({_PATHQ}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATHQ}, '/+$', '') END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"


def _resolve_sql(source: str) -> str:
    """source (page_id, url, pos, href, label) with abs, contact and key; links that are cut are left out."""
    return rf"""
    SELECT * EXCLUDE (raw, own, tail, full_path, parts, folded), CASE WHEN contact THEN raw ELSE {_KEY.format('abs')} END AS key FROM (
      SELECT *, CASE WHEN contact OR regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw WHEN starts_with(raw, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || raw WHEN starts_with(raw, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || raw
        ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN folded || mark = '' THEN '/' ELSE folded || mark END || tail END AS abs FROM (
        SELECT *, list_reduce(parts, lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END, '') AS folded, CASE WHEN parts[-1] IN ('.', '..') THEN '/' ELSE '' END AS mark FROM (
          SELECT *, string_split(full_path, '/')[2:] AS parts FROM (
            SELECT *, CASE WHEN starts_with(own, '/') THEN own ELSE regexp_replace('/' || regexp_replace({_PATHQ.format('url')}, '[^/]*$', '') || own, '/{{2,}}', '/', 'g') END AS full_path FROM (
              SELECT *, regexp_extract(raw, '^([^?#]*)', 1) AS own, regexp_extract(raw, '^[^?#]*(.*)$', 1) AS tail, regexp_matches(raw, '(?i)^(mailto|tel):') AS contact FROM (SELECT *, trim(coalesce(href, '')) AS raw FROM {source}) WHERE raw <> ''
    ))))) WHERE contact OR (NOT regexp_matches(raw, '(?i)^(javascript|data|blob|about):') AND NOT starts_with(raw, '#') AND regexp_matches(abs, '(?i)^https?://') AND {_KEY.format('abs')} <> {_KEY.format('url')})"""


def _digest_sql(source: str) -> str:
    return f"""
    WITH d AS (SELECT *, trim(label) AS lab FROM ({_resolve_sql(source)})),
    e AS (SELECT page_id, url, key, min(pos) AS first, arg_min(abs, pos) AS href, bool_or(contact) AS is_contact FROM d GROUP BY ALL),
    l AS (SELECT page_id, key, list(lab ORDER BY p) AS labels FROM (SELECT page_id, key, lab, min(pos) AS p FROM d WHERE lab <> '' GROUP BY ALL) GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first)::INT AS handle FROM e)
    SELECT page_id, handle, coalesce(labels, []) AS labels, href, NOT is_contact AND {_SITE.format('href')} <> {_SITE.format('url')} AS off_domain, is_contact FROM h LEFT JOIN l USING (page_id, key) WHERE handle <= 200"""


@query(f"SELECT page_id, pos, abs AS href, key, contact AS is_contact FROM ({_resolve_sql(HREFS.sql)})")
def url2_lnk2_resolved(spark, sf_dir):
    found = HREFS.df(spark, sf_dir).select("page_id", "pos", L.resolved(F.col("url"), F.col("href")).alias("r")).where("r is not null")
    return found.select("page_id", "pos", "r.href", "r.key", "r.is_contact")


@query(f"SELECT page_id, handle, array_to_string(labels, '|') AS labels, href, off_domain, is_contact FROM ({_digest_sql(HREFS.sql)})")
def agg26_win2_digest_of_odd_links(spark, sf_dir):
    return L.digest(HREFS.df(spark, sf_dir)).withColumn("labels", F.array_join("labels", "|"))


_A = r"""'(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))[^>]*>(.*?)</a>'"""
_ANCHORS = rf"""(SELECT page_id, url, pos, regexp_extract(a, {_A}, 1) || regexp_extract(a, {_A}, 2) || regexp_extract(a, {_A}, 3) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, {_A}, 4), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {_A})) AS a, generate_subscripts(regexp_extract_all(html, {_A}), 1) - 1 AS pos FROM pages))"""


@query(f"SELECT page_id, handle, array_to_string(labels, '|') AS labels, href, off_domain, is_contact FROM ({_digest_sql(_ANCHORS)})")
def agg26_link_digest(spark, sf_dir):
    return L.digest(L.anchors(table(spark, sf_dir, "pages"))).withColumn("labels", F.array_join("labels", "|"))


_SHOWN = f"CASE WHEN off_domain THEN {_NETLOC.format('href')} ELSE '' END || CASE WHEN {_PATHQ.format('href')} = '' THEN '/' ELSE {_PATHQ.format('href')} END || CASE WHEN {_QUERY.format('href')} <> '' THEN '?' || {_QUERY.format('href')} ELSE '' END"


@query(f"SELECT page_id, string_agg('{{{{' || handle || '}}}} ' || CASE WHEN len(labels) > 0 THEN array_to_string(labels, ' / ') ELSE '(no label)' END || ' · ' || CASE WHEN is_contact THEN href ELSE {_SHOWN} END, chr(10) ORDER BY handle) AS block FROM ({_digest_sql(HREFS.sql)}) GROUP BY page_id")
def str15_digest_block(spark, sf_dir):
    c = F.col
    line = L.rendered(c("handle"), c("labels"), c("href"), c("off_domain"), c("is_contact"))
    rows = L.digest(HREFS.df(spark, sf_dir)).select("page_id", F.struct("handle", line.alias("line")).alias("r"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("block"))


ANSWERS = Fixture("pages/8: page_id int, text string", [(0, "See {{1}} and {{3}}, not {{99}} or {{ 2 }} {{x}}."), (1, "{{1}}{{1}}"), (2, "no handle"), (7, "lost {{1}}")])


@query(rf"""
    WITH t AS (SELECT a.page_id, text, unnest(CASE WHEN len(m) = 0 THEN [NULL] ELSE m END) AS h FROM (SELECT *, regexp_extract_all(text, '\{{\{{(\d+)\}}\}}', 1) AS m FROM {ANSWERS.sql}) a),
    r AS (SELECT t.page_id, text, list(struct_pack(h := t.h, href := coalesce(d.href, ''))) FILTER (WHERE t.h IS NOT NULL) AS s FROM (SELECT DISTINCT * FROM t) t LEFT JOIN ({_digest_sql(HREFS.sql)}) d ON d.page_id = t.page_id AND d.handle = t.h::INT GROUP BY ALL)
    SELECT page_id, list_reduce(list_prepend(text, list_transform(coalesce(s, []), lambda x: x.h || chr(1) || x.href)), lambda a, x: replace(a, '{{{{' || split_part(x, chr(1), 1) || '}}}}', split_part(x, chr(1), 2))) AS text FROM r
""")
def str7_rehydrated(spark, sf_dir):
    hrefs = L.digest(HREFS.df(spark, sf_dir)).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("handle", "href"))).alias("t"))
    return ANSWERS.df(spark, sf_dir).join(hrefs, "page_id", "left").select("page_id", L.rehydrated(F.col("text"), F.coalesce("t", F.create_map().cast("map<int,string>"))).alias("text"))


ENTRIES = Fixture("pages/8: page_id int, pos int, handle int, url string, reason string, kind string", [
    (0, 0, 1, None, "specific one", "drilldown"), (0, 1, 999, None, "unknown", "drilldown"), (0, 2, None, "https://x.com/n", "discussed page", "drilldown"), (0, 3, None, "", "empty", "structural"), (0, 4, None, None, "none", "structural"),
    (0, 5, None, "https://x.com/n", "its own words", "drilldown"), (0, 6, None, "https://x.com/m", "item page", "drilldown"), (0, 7, None, "https://x.com/m", "item page", "structural"), (0, 8, None, "https://x.com/m", "discussion thread", "structural"),
    (1, 0, 2, "https://kept.com/", "by handle", "structural"), (1, 1, None, "https://w.com/1", "one", "structural"), (1, 2, None, "https://w.com/1", "two", "drilldown"), (1, 3, None, "https://w.com/1", "three", "structural")] + [(2, i, None, f"https://z.com/{i % 13}", f"r{i}", "drilldown") for i in range(30)])


@query(f"SELECT e.page_id, pos, coalesce(d.href, url) AS url, reason, kind, coalesce(d.off_domain, false) AS off_domain FROM {ENTRIES.sql} e LEFT JOIN ({_digest_sql(HREFS.sql)}) d ON d.page_id = e.page_id AND d.handle = e.handle WHERE d.href IS NOT NULL OR (e.handle IS NULL AND url <> '')")
def jon1_handled_pages(spark, sf_dir):
    return L.handled_pages(ENTRIES.df(spark, sf_dir), L.digest(HREFS.df(spark, sf_dir)))


@query(f"""
    WITH k AS (SELECT *, min(pos) OVER (PARTITION BY page_id, url) AS seen, row_number() OVER (PARTITION BY page_id, url ORDER BY reason IN ('discussed page', 'item page', 'discussion thread'), kind <> 'structural', pos) AS k FROM {ENTRIES.sql} WHERE url <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seen)::INT AS place FROM k WHERE k = 1)
    SELECT page_id, place, url, reason, kind FROM o WHERE place <= 10
""")
def agg27_pln23_merged_pages(spark, sf_dir):
    return L.merged_pages(ENTRIES.df(spark, sf_dir).where("url <> ''"))


GATES = Fixture("pages/8: page_id int, handle int, label string, stated_count int", [(0, 1, "Reviews", 12), (0, 2, "Specs", None), (1, 1, "Q&A", 3)])
BLOCKED = Fixture("pages/8: page_id int, blocked_gate int", [(0, 2), (0, 9), (1, None), (2, 1)])


@query(f"SELECT b.page_id, b.blocked_gate, g.label, CASE WHEN g.stated_count IS NULL THEN g.label ELSE g.label || ' (' || g.stated_count || ')' END AS shown FROM {BLOCKED.sql} b LEFT JOIN {GATES.sql} g ON g.page_id = b.page_id AND g.handle = b.blocked_gate")
def jon2_str16_blocked_gate(spark, sf_dir):
    g = GATES.df(spark, sf_dir).withColumnRenamed("handle", "blocked_gate")
    shown = F.when(F.col("stated_count").isNull(), F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.col("stated_count").cast("string"), F.lit(")")))
    return BLOCKED.df(spark, sf_dir).join(g, ["page_id", "blocked_gate"], "left").select("page_id", "blocked_gate", "label", shown.alias("shown"))


MODEL = Fixture("pages/8: page_id int, pos int, url string, anchor string, kind string", [(0, 0, "https://a.com/1", "one", "drilldown"), (0, 1, "https://made.up/", "gone", "source"), (0, 2, "https://h.com/2", "two", "related"), (1, 0, "https://a.com/1", "x", "related")] + [(3, i, f"https://m.com/{i}", "m", "related") for i in range(7)])
HANDLER = Fixture("pages/8: page_id int, pos int, url string, anchor string, kind string", [(0, 0, "https://h.com/2", "two", "drilldown"), (0, 1, "https://h.com/3", "three", "discussion"), (2, 0, "https://h.com/4", "four", "drilldown")] + [(3, i, f"https://m.com/{i + 5}", "h", "drilldown") for i in range(9)])
BODIES = Fixture("pages/8: page_id int, markdown string", [(0, "see [one](https://a.com/1) there"), (3, "https://m.com/0")])


@query(f"SELECT m.page_id, pos, m.url, anchor, kind, coalesce(contains(markdown, m.url), false) OR EXISTS (SELECT 1 FROM {HANDLER.sql} h WHERE h.page_id = m.page_id AND h.url = m.url) AS kept FROM {MODEL.sql} m LEFT JOIN {BODIES.sql} b ON b.page_id = m.page_id")
def jon3_grounded_links(spark, sf_dir):
    return L.grounded(MODEL.df(spark, sf_dir), BODIES.df(spark, sf_dir), HANDLER.df(spark, sf_dir))


@query(f"""
    WITH b AS (SELECT *, 0 AS part FROM {MODEL.sql} UNION ALL SELECT *, 1 FROM {HANDLER.sql} h WHERE NOT EXISTS (SELECT 1 FROM {MODEL.sql} m WHERE m.page_id = h.page_id AND m.url = h.url)), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, pos)::INT AS place FROM b)
    SELECT page_id, place, url, anchor, kind FROM o WHERE place <= 10
""")
def jon4_set1_lim1_composed_links(spark, sf_dir):
    return L.composed(MODEL.df(spark, sf_dir), HANDLER.df(spark, sf_dir))


_HOSTS = Fixture("events: id int, url string", [(i, *u) for i, u in enumerate([("https://web.archive.org/web/2020/x",), ("http://x.archive.org/",), ("https://archive.ph/abc",), ("https://notarchive.org/",), ("https://User@Archive.is:443/q",), ("https://live.example.com/a?b=c#d",), ("https://example.com",), ("https://badexample.com/",), ("/relative/path?x#y",), ("mailto:a@b.c",)])])


@query(f"""
    SELECT id, url, lower({_NETLOC.format('url')}) AS host, {_PATHQ.format('url')} AS path, {_QUERY.format('url')} AS query, regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment,
    {_HOSTNAME.format('url')} IN ({', '.join(_q(h) for h in L.ARCHIVES)}) OR {_HOSTNAME.format('url')} LIKE '%.archive.org' AS mirror, {_HOSTNAME.format('url')} = 'example.com' OR {_HOSTNAME.format('url')} LIKE '%.example.com' AS live_only FROM {_HOSTS.sql}
""")
def url1_flt1_flt5_hosts(spark, sf_dir):
    u = F.col("url")
    return _HOSTS.df(spark, sf_dir).select("id", "url", L.host(u).alias("host"), L.path(u).alias("path"), L.query_string(u).alias("query"), L.fragment(u).alias("fragment"), L.archive_mirror(u).alias("mirror"), L.under(L.hostname(u), ["example.com"]).alias("live_only"))


# Records of three pages: heading anchor and href, and one further link.
_RECORDS = [(0, "https://news.x.com/", 0, "Story", "https://blog.org/1", "12 comments", "https://news.x.com/item?id=1"), (0, "https://news.x.com/", 1, "", "https://www.news.x.com/2", "comments", "https://news.x.com/item?id=2"), (0, "https://news.x.com/", 2, "Again", "https://blog.org/1", "1 comment", "/item?id=3"), (0, "https://news.x.com/", 3, None, None, "5 Comments", "https://other.org/5"), (1, "https://www.shop.com/l", 0, "Item", "https://shop.com/i", "see", "https://shop.com/r"), (1, "https://www.shop.com/l", 1, "Old", "https://web.archive.org/x", "3 comments", "https://web.archive.org/y")]
RECORDS = Fixture("pages: page_id int, url string, pos int, anchor string, href string, anchor2 string, href2 string", _RECORDS)


@query(rf"""
    WITH c AS (SELECT page_id, pos, 0 AS part, coalesce(nullif(anchor, ''), href) AS anchor, href, {_HOSTNAME.format('href')} = '' OR regexp_replace({_HOSTNAME.format('href')}, '^www\.', '') = regexp_replace({_HOSTNAME.format('url')}, '^www\.', '') AS inside FROM {RECORDS.sql} WHERE href IS NOT NULL
        UNION ALL SELECT page_id, pos, 1, coalesce(nullif(anchor2, ''), href2), href2, NULL FROM {RECORDS.sql} WHERE regexp_matches(anchor2, '(?i)\b\d+\s*comments?\b') AND {_HOSTNAME.format('href2')} IN ('', {_HOSTNAME.format('url')})),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos, part) AS k FROM c WHERE NOT ({_HOSTNAME.format('href')} IN ({', '.join(_q(h) for h in L.ARCHIVES)}) OR {_HOSTNAME.format('href')} LIKE '%.archive.org'))
    SELECT page_id, pos, part, anchor, href AS url, CASE WHEN inside IS NULL THEN 'discussion thread' WHEN inside THEN 'item page' ELSE 'discussed page' END AS reason, CASE WHEN inside IS NULL THEN 'discussion' WHEN inside THEN 'drilldown' ELSE 'source' END AS kind FROM k WHERE k = 1
""")
def pln22_record_links(spark, sf_dir):
    link = lambda a, h: F.struct(F.col(a).alias("anchor"), F.col(h).alias("href"))
    return L.record_links(RECORDS.df(spark, sf_dir).select("page_id", "url", "pos", link("anchor", "href").alias("heading"), F.array(link("anchor2", "href2")).alias("links")))
