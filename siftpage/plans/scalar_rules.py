"""Registered queries over written-out values of scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.functions import texts as T
from siftpage.operators import links as L
from siftpage.plans.fixtures import Fixture
from siftpage.plans.linking import _HOSTNAME, _PATHQ, _QUERY
from siftpage.plans.queries import _q, query, table

_TIMES = Fixture("events: id int, ms long, hours double, stamp string, reset string, attempt int, content_type string, volatility string, iso string", [
    (0, 0, None, "20230415120000", "12", 0, "text/html", None, "2024-05-01T10:00:00+02:00"), (1, 999, 0.5, "2023041512000", "39.5", 1, "TEXT/HTML; x", "live", "2024-05-01"), (2, 1000, 0.9999, "20231345120000", "40", 0, "application/json", "article", "not a time"),
    (3, 6999, 1.5, None, "40.5", 0, None, "static", None), (4, 7000, 2.5, "20300101000000", "soon", 0, "application/json", None, "2024-05-01T10:00:00.25Z"), (5, 59999, 100.0, "19991231235959", None, 1, "", None, ""), (6, 60000, 0.0, "x", None, 2, "image/png", None, "1969-12-31T23:59:59Z"), (7, 3723000, 0.025, "", "-3", 5, "text/HTML", None, "2024-02-30T00:00:00Z")])


@query(rf"""
    SELECT id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 7000 THEN format('{{:.1f}}s', ms / 1000.0) WHEN ms < 60000 THEN ms // 1000 || 's' ELSE format('{{}}m{{:02d}}s', ms // 60000, (ms // 1000) % 60) END AS duration,
    CASE WHEN hours IS NULL THEN 'never' WHEN hours < 1 THEN round_even(hours * 60, 0)::BIGINT || 'm' ELSE round_even(hours, 0)::BIGINT || 'h' END AS age,
    CASE WHEN regexp_matches(stamp, '^[0-9]{{14}}$') THEN try_strptime(stamp, '%Y%m%d%H%M%S')::DATE END AS taken, CASE WHEN regexp_matches(stamp, '^[0-9]{{14}}$') AND try_strptime(stamp, '%Y%m%d%H%M%S') IS NOT NULL THEN greatest(0, DATE '2024-01-01' - try_strptime(stamp, '%Y%m%d%H%M%S')::DATE)::INT END AS days,
    CASE WHEN TRY_CAST(reset AS DOUBLE) > 40 THEN NULL WHEN TRY_CAST(reset AS DOUBLE) IS NOT NULL THEN least(TRY_CAST(reset AS DOUBLE) + 1, 40) WHEN attempt = 0 THEN 0.5 WHEN attempt = 1 THEN 1.5 END AS wait,
    CASE volatility WHEN 'live' THEN 300 WHEN 'article' THEN 86400 WHEN 'static' THEN 604800 ELSE CASE WHEN lower(content_type) LIKE '%html%' THEN 86400 ELSE 604800 END END AS ttl, epoch_us(TRY_CAST(iso AS TIMESTAMPTZ)) / 1e6 AS epoch FROM {_TIMES.sql}
""")
def dat2_dat7_times(spark, sf_dir):
    c = F.col
    taken = T.taken_on(c("stamp"))
    t = _TIMES.df(spark, sf_dir).select("id", T.duration(c("ms")).alias("duration"), T.age_label(c("hours")).alias("age"), taken.alias("taken"), "reset", "attempt", "content_type", "volatility", "iso")
    return t.select("id", "duration", "age", "taken", T.age_days(c("taken"), F.lit("2024-01-01").cast("date")).alias("days"), T.wait_seconds(c("reset"), c("attempt")).alias("wait"), T.time_to_live(c("content_type"), c("volatility")).alias("ttl"), T.epoch(c("iso")).alias("epoch"))


_STATES = Fixture("events: id int, source string, refreshed long, value double, base double, shown int, total int, day string", [(0, "none", None, 3.456, 1.0, 25, 900, "2018-01-01"), (1, "firefox", None, 1.0, 3.456, 25, 25, "2018-01-02"), (2, "firefox", 1000, None, 1.0, 25, None, None), (3, "firefox", 90000, 20.0, 5.5, 0, 1, "2020-12-01"), (4, "firefox", 99999, 2.0, 2.0, 30, 20, "2000-01-01"), (5, "chrome", 13600, 1.0, 12.25, 1, 2, "2000-02-01")])


@query("""
    SELECT id, CASE WHEN source = 'none' THEN false WHEN refreshed IS NULL THEN true ELSE (100000 - refreshed) / 3600.0 > 24 END AS stale, CASE WHEN value IS NULL OR base IS NULL THEN '—' ELSE CASE WHEN value - base >= 0 THEN '+' ELSE '' END || CASE WHEN abs(value - base) >= 10 THEN format('{:.0f}', value - base) ELSE format('{:.2f}', value - base) END END AS delta,
    CASE WHEN total > shown THEN '_Showing ' || shown || ' of ' || total || ' replies — this is a partial view._' || chr(10) ELSE '' END AS note, CASE WHEN month(day) = 1 AND dayofmonth(day) = 1 THEN NULL ELSE day END AS published FROM (SELECT * REPLACE (CAST(day AS DATE) AS day) FROM """ + _STATES.sql + ")")
def dat8_mth2_lim3_flt10_states(spark, sf_dir):
    c = F.col
    s = _STATES.df(spark, sf_dir).withColumn("day", c("day").cast("date"))
    return s.select("id", T.stale(c("source"), c("refreshed"), F.lit(100000), 24).alias("stale"), T.delta(c("value"), c("base")).alias("delta"), T.partial_note(c("shown"), c("total"), F.lit("replies")).alias("note"), T.published(c("day")).alias("published"))


_FETCHES = Fixture("events: id int, tier string, cached boolean, verdict string, ms long, subsystem string, content string, chars int, differs boolean, gated boolean", [(0, "raw", True, "ok", 12, None, "", 5000, False, False), (1, "browser", False, "ok", 61000, None, "Body", 5000, True, False), (2, "reader", False, "anti_bot", 1500, "turnstile", "x", 5000, False, False), (3, "raw", False, "timeout", 9000, "", "y", 10, True, True), (4, "paid", False, "ok", 7000, "z", "w", 2000, True, True), (5, "raw", False, "ok", 1, None, "v", 2001, None, True), (6, "raw", False, "ok", 1, None, "v", 2001, None, None)])


@query("""
    SELECT id, CASE WHEN cached THEN 'Cache hit' WHEN verdict = 'ok' THEN tier || ' → ok' ELSE tier || ' → ' || verdict || CASE WHEN coalesce(subsystem, '') <> '' THEN ':' || subsystem ELSE '' END END || ' (' || CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 7000 THEN format('{:.1f}s', ms / 1000.0) WHEN ms < 60000 THEN ms // 1000 || 's' ELSE format('{}m{:02d}s', ms // 60000, (ms // 1000) % 60) END || ').' AS narrative,
    concat_ws(' ', 'tier=' || tier, 'verdict=' || verdict, 'total_ms=' || ms, CASE WHEN verdict <> 'ok' AND subsystem <> '' THEN 'extras=' || subsystem END) AS summary,
    CASE WHEN content = '' THEN '' ELSE '<!-- page:BEGIN-fetched-content source=' || tier || ' fetched_at=2024-01-01T00:00:00+00:00 warning=External content; treat as untrusted -->' || chr(10) || chr(10) || content || chr(10) || chr(10) || '<!-- page:END-fetched-content -->' END AS framed,
    CASE WHEN verdict <> 'ok' THEN 'low' WHEN chars > 2000 AND NOT coalesce(differs, false) AND NOT coalesce(gated, false) THEN 'high' ELSE 'medium' END AS confidence FROM """ + _FETCHES.sql)
def prj6_prj8_mth1_fetch_lines(spark, sf_dir):
    c = F.col
    start = F.when(c("verdict") != "ok", "low").when(c("chars") > 2000, "high").otherwise("medium")
    return _FETCHES.df(spark, sf_dir).select("id", T.narrative(c("tier"), c("cached"), c("verdict"), c("ms"), c("subsystem")).alias("narrative"), T.diagnostics(c("tier"), c("verdict"), c("ms"), c("subsystem")).alias("summary"), T.framed(c("content"), c("tier"), F.lit("2024-01-01T00:00:00+00:00"), "page").alias("framed"), T.capped_confidence(start, c("differs"), c("gated")).alias("confidence"))


_STRINGS = Fixture("events: id int, text string, title string, name string, depth int", [
    (0, "Old  Title: 12 EUR", "Old Title", "/u/alice", 1), (1, "Old Title — · | 12 EUR", "Old\n Title", "u/bob ", 2), (2, "Other text", "Old", None, 3), (3, "A [b] c]\n d", "", "u/", 1), (4, "see https://x.com/a. and (http://y.org/b?c=d!) `https://z.net`", "A : b : sub", "plain", 1), (5, "line one\n\nline <!-- SC_ON --> footer", "no colon", "", 2), (6, "", " : only", "/u/u/x", 1), (7, "https://... https://!", "end : ", "u", 4)])


@query(rf"""
    SELECT id, trim(regexp_replace(translate(text, '[]', ''), '\s+', ' ', 'g')) AS link_text, CASE WHEN p <> '' AND starts_with(text, p) THEN trim(regexp_replace(substr(text, length(p) + 1), '^[ \-–—:·|]+', '')) ELSE text END AS detail,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(repeat('>', depth) || ' ' || x)), chr(10)) AS quoted, array_to_string(list_filter(list_transform(regexp_extract_all(text, 'https?://[^\s<>)\]"''`]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), lambda u: u <> ''), ' ') AS urls,
    nullif(trim(regexp_replace(regexp_replace(name, '^/u/', ''), '^u/', '')), '') AS user_name, nullif(trim(regexp_replace(title, '(?s)^(.*) : .*$', '\1')), '') AS thread, split_part(text, '<!-- SC_ON -->', 1) AS authored, left(sha256(title || '|' || CASE WHEN depth > 1 THEN 'True' ELSE 'False' END), 16) AS profile
    FROM (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS p FROM {_STRINGS.sql})
""")
def str2_str8_str9_str12_str13_str14(spark, sf_dir):
    c = F.col
    return _STRINGS.df(spark, sf_dir).select("id", T.link_text(c("text")).alias("link_text"), T.without_title(c("text"), c("title")).alias("detail"), T.quoted(c("text"), c("depth")).alias("quoted"), F.array_join(T.prose_urls(c("text")), " ").alias("urls"), T.user_name(c("name")).alias("user_name"), T.thread_title(c("title")).alias("thread"), T.authored(c("text")).alias("authored"), T.profile(c("title"), c("depth") > 1).alias("profile"))


_SEARCHES = Fixture("events: id int, url string", [(i, u) for i, u in enumerate(["https://www.google.com/search?q=a+b%2Fc", "https://google.com/search/?x=1&q=%C3%A4~*", "https://www.bing.com/search?q=", "https://bing.com/maps?q=x", "https://example.com/search?q=x", "https://WWW.Google.com:443/search?hl=en&q=two%20words&q=second", "https://google.com/search", "https://google.com/search?pq=x"])])


@query(f"""
    WITH p AS (SELECT id, url, {_HOSTNAME.format('url')} AS host, {_PATHQ.format('url')} AS path, regexp_extract('&' || {_QUERY.format('url')}, '&q=([^&]+)', 1) AS raw FROM {_SEARCHES.sql})
    SELECT id, url, CASE WHEN host IN ('google.com', 'www.google.com', 'bing.com', 'www.bing.com') AND path IN ('/search', '/search/') AND raw <> '' THEN 'https://duckduckgo.com/html/?q=' || replace(url_encode(url_decode(replace(raw, '+', ' '))), '%2F', '/') END AS target FROM p
""")
def url4_past_captcha(spark, sf_dir):
    u = F.col("url")
    return _SEARCHES.df(spark, sf_dir).select("id", "url", T.past_captcha(L.hostname(u), L.path(u), L.query_string(u)).alias("target"))


_ANSWERS = Fixture("events: id int, body string, status int, detail string, content_type string", [
    (0, "Title: x\nTarget URL returned error 404: Not Found\nMarkdown Content:\nbody", 404, None, "text/html"), (1, "Title: x\nMarkdown Content:\nIt says Target URL returned error 403", 403, "net::ERR_CONNECTION_RESET at x", "application/json"), (2, "Warning: Target URL returned error 401", 401, "Execution context was destroyed", "text/plain"), (3, "Target URL returned error 429", 429, "", "text/html"), (4, "Target URL returned error 503", 503, "ERR_EMPTY_RESPONSE", "text/html"), (5, '  {"a": [1, 2]}', 200, "timeout", "text/plain"), (6, "[1, 2", 200, None, "text/html"), (7, '{"b": 1}', 200, None, "application/ld+json"), (8, "<html>{}</html>", 200, None, "image/png"), (9, "", 200, None, "")])


@query("""
    WITH a AS (SELECT *, TRY_CAST(regexp_extract(split_part(body, 'Markdown Content:', 1), 'Target URL returned error (\\d{3})', 1) AS INT) AS up, regexp_matches(body, '^\\s*[\\[{]') AND TRY_CAST(body AS JSON) IS NOT NULL AS is_json, regexp_matches(content_type, '(?i)^(application|text)/([^;]*\\+)?json') AS says_json FROM """ + _ANSWERS.sql + """),
    v AS (SELECT *, CASE WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 400 THEN 'connection_error' WHEN says_json OR lower(content_type) LIKE '%html%' THEN 'ok' ELSE 'content_type_mismatch' END AS plain FROM a)
    SELECT id, up AS upstream, CASE WHEN up IN (401, 403) THEN 'paywall' WHEN up = 404 THEN 'not_found' WHEN up = 429 THEN 'rate_limited' WHEN up >= 400 THEN 'connection_error' ELSE 'ok' END AS reader, CASE WHEN status = 404 THEN 'not_found' WHEN status IN (401, 403) THEN 'paywall' ELSE 'connection_error' END AS rendered,
    coalesce(regexp_matches(detail, 'ERR_HTTP2_PROTOCOL_ERROR|ERR_HTTP2_SERVER_REFUSED_STREAM|ERR_QUIC_PROTOCOL_ERROR|ERR_CONNECTION_RESET|ERR_CONNECTION_CLOSED|ERR_CONNECTION_REFUSED|ERR_EMPTY_RESPONSE'), false) AS wall, CASE WHEN plain IN ('ok', 'content_type_mismatch') AND NOT says_json AND is_json THEN 'ok' ELSE plain END AS raw, CASE WHEN plain IN ('ok', 'content_type_mismatch') AND NOT says_json AND is_json THEN 'application/json' ELSE content_type END AS kind, is_json AS payload FROM v
""")
def src6_src7_src10_src12_answers(spark, sf_dir):
    from siftpage.functions.scalars import JSON_TYPE, raw_verdict

    c = F.col
    up = T.upstream_status(c("body"))
    is_json = c("body").rlike(r"^\s*[\[{]") & F.try_parse_json("body").isNotNull()
    a = _ANSWERS.df(spark, sf_dir).select("*", up.alias("upstream"), is_json.alias("payload"), raw_verdict(c("status"), c("content_type")).alias("plain"), c("content_type").rlike(JSON_TYPE).alias("says"))
    sniffed = c("plain").isin("ok", "content_type_mismatch") & ~c("says") & c("payload")
    return a.select("id", "upstream", F.coalesce(T.upstream_verdict(c("upstream")), F.lit("ok")).alias("reader"), T.rendered_verdict(c("status")).alias("rendered"), T.wall_shaped(c("detail")).alias("wall"), F.when(sniffed, "ok").otherwise(c("plain")).alias("raw"), F.when(sniffed, "application/json").otherwise(c("content_type")).alias("kind"), "payload")


_DENIED = ["reddit.com", "Example.NET"]


@query(f"SELECT page_id FROM pages WHERE {' OR '.join(f'''{_HOSTNAME.format('url')} = '{h.lower()}' OR {_HOSTNAME.format('url')} LIKE '%.{h.lower()}' ''' for h in _DENIED)}")
def src8_denied_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(L.under(L.hostname(F.col("url")), [h.lower() for h in _DENIED])).select("page_id")


_COPIES = Fixture("events: id int, source string, arrived int, html string, stamp string", [(0, "wayback", 20, "<p>a</p><!-- BEGIN WAYBACK TOOLBAR INSERT -->x\n<!--  END WAYBACK TOOLBAR INSERT --><b>", "20200101000000"), (0, "mirror", 10, None, None), (1, "wayback", 30, '<div id="wm-ipp-base" class=x>\n</div>kept', "20240601120000"), (1, "mirror", 20, "first", None), (2, "wayback", 5, None, None)])


@query("""
    WITH f AS (SELECT id, arg_min(source, arrived) FILTER (WHERE html IS NOT NULL) AS source, arg_min(html, arrived) FILTER (WHERE html IS NOT NULL) AS html, arg_min(stamp, arrived) FILTER (WHERE html IS NOT NULL AND stamp IS NOT NULL) AS stamp0, min(arrived) FILTER (WHERE html IS NOT NULL) AS at FROM """ + _COPIES.sql + """ GROUP BY id)
    SELECT id, source, regexp_replace(regexp_replace(html, '(?is)<!--\\s*BEGIN WAYBACK TOOLBAR INSERT.*?<!--\\s*END WAYBACK TOOLBAR INSERT\\s*-->', '', 'g'), '(?is)<div id="wm-ipp-base".*?</div>', '', 'g') AS html, CASE WHEN source = 'wayback' THEN strptime(stamp0, '%Y%m%d%H%M%S')::DATE END AS taken FROM f
""")
def src9_dat3_archive_race(spark, sf_dir):
    c = F.col
    first = F.min_by(F.struct("source", "html", "stamp"), F.when(c("html").isNotNull(), c("arrived")))
    got = _COPIES.df(spark, sf_dir).groupBy("id").agg(first.alias("f"))
    return got.select("id", "f.source", T.without_toolbar(c("f.html")).alias("html"), T.taken_on(c("f.stamp")).alias("taken"))


_TEXTS = Fixture("events: id int, text string, urls array<string>", [(0, "see https://a.b/c and https://a.b/c(d)", ["https://a.b/c", "", "https://x"]), (1, "nothing", []), (2, "a.b a.b", ["a.b"])])


@query(f"SELECT id, list_reduce(list_prepend(text, list_filter(urls, lambda u: u <> '')), lambda t, u: replace(t, u, '[url-redacted]')) AS text FROM {_TEXTS.sql}")
def prj5_redacted_urls(spark, sf_dir):
    return _TEXTS.df(spark, sf_dir).select("id", T.redacted(F.col("text"), F.col("urls")).alias("text"))


_COOKIE = Fixture("events: name string, host_key string, path string, value string", [("s", ".a.com", "/", "secret"), ("t", "b.com", "/x", "")])


@query(f"SELECT name, host_key, path, length(value)::INT AS value_length FROM {_COOKIE.sql}")
def prj4_redacted_cookies(spark, sf_dir):
    return _COOKIE.df(spark, sf_dir).select("name", "host_key", "path", F.length("value").alias("value_length"))


_META = Fixture("events: id int, keys array<string>, vals array<string>", [(0, ["og.description", "og.image", "x"], ["d", "", "y"]), (1, ["twitter.image", "jsonld[0].image"], ["t", "j"]), (2, ["og.title"], ["z"]), (3, ["jsonld[0].image", "og.description"], ["j", "e"])])


@query(f"""
    WITH m AS (SELECT id, unnest(keys) AS k, unnest(vals) AS v FROM {_META.sql}), d AS (SELECT id, max(v) FILTER (WHERE k = 'og.description') AS description, coalesce(max(v) FILTER (WHERE k = 'og.image' AND v <> ''), max(v) FILTER (WHERE k = 'twitter.image' AND v <> ''), max(v) FILTER (WHERE k = 'jsonld[0].image' AND v <> '')) AS image FROM m GROUP BY id)
    SELECT id, description, image, (CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN image IS NULL THEN 0 ELSE 1 END)::INT AS n FROM d
""")
def prj3_map1_curated_meta(spark, sf_dir):
    m = _META.df(spark, sf_dir).select("id", T.curated(F.map_from_arrays("keys", "vals")).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k.split(".")[-1])
    return m.select("id", get("og.description"), get("image"), F.size("m").alias("n"))


_ROLES = Fixture("pages/3: page_id int, pos int, href string, role string", [(0, 0, "a", "primary"), (0, 1, "b", "nav"), (0, 2, "c", "footer"), (1, 0, "d", "meta"), (1, 1, "e", None)])
_ASKED = Fixture("pages/3: page_id int, include boolean, roles array<string>", [(0, True, ["primary", "nav"]), (1, True, None), (2, True, ["primary"])])


@query(f"SELECT r.page_id, pos, href FROM {_ROLES.sql} r JOIN {_ASKED.sql} a ON a.page_id = r.page_id WHERE include AND (roles IS NULL OR list_contains(roles, role))")
def prj1_link_roles(spark, sf_dir):
    return _ROLES.df(spark, sf_dir).join(_ASKED.df(spark, sf_dir), "page_id").where("include and (roles is null or array_contains(roles, role))").select("page_id", "pos", "href")
