"""Registered queries over pages with embedded data."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import structured as S
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query
from siftpage.plans.retrieval import rows

_LD = '<script type="application/ld+json">{}</script>'.format
_HTML = [
    _LD('{"@type": "Product", "name": "Lamp §", "image": "x.png", "sku": 12, "offers": {"@type": "Offer", "price": "9.90", "priceCurrency": "EUR"}, "color": ["red", "blue"], "review": [{"author": "A", "stars": 4}, {"author": "B"}], "empty": "", "none": null}') + '<script id="__NEXT_DATA__" type="application/json">{"props": {"a": 1}}</script><meta property="og:title" content="A | lamp"><meta property="og:type" content="product"><meta property="og:title" content="again"><meta name="x" content="y">',
    _LD('[{"@type": ["Store", "LocalBusiness"], "name": "Shop §"}, {"@graph": [{"@type": "WebSite", "name": "S", "url": "u"}, {"@type": "NewsArticle", "headline": "H", "datePublished": "2024", "author": {"name": "Z"}}]}]') + '<script id="__NUXT_DATA__">[1, 2]</script>',
    _LD("{broken") + "<script>window.state = {\"k\": [1]};</script><script type='text/javascript'>window.other = {};</script><script type=\"application/json\" data-app=\"1\">{\"big\": \"" + "x" * 60 + "\"}</script><script type=\"application/json\">{\"no\": 1}</script>",
    _LD('{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"name": "One [1]", "offers": {"price": 5, "priceCurrency": "TRY", "availability": "https://schema.org/InStock", "seller": {"name": "Me"}, "url": "/1"}, "aggregateRating": {"ratingValue": 4.5}}}, {"name": "Two", "url": "/2", "price": "7", "stock": "few"}, {"headline": "Three", "offers": {"seller": "You", "availability": "OutOfStock"}}, 4]}') + _LD('{"@type": "Recipe", "name": "Soup", "recipeYield": "4", "recipeIngredient": ["a", "b"], "recipeInstructions": "' + "Stir. " * 100 + '"}'),
    _LD("[" + ", ".join('{"@type": "Event", "name": "E%d"}' % i for i in range(15)) + ', {"@type": "ImageObject"}, {"@type": "Organization", "a": {"b": {"c": {"d": {"e": 1}}}}, "list": [{"x": 1}, {"y": [1, 2]}, "s"]}]'),
    "<p>nothing</p>",
]
PAGES = Fixture("pages: page_id int, html string", list(enumerate(_HTML)))
_TAG = r"'(?is)<script\b([^>]*)>(.*?)</script>'"
_ATTR = """regexp_extract({0}, '(?is)\\b{1}\\s*=\\s*["'']([^"'']*)["'']', 1)""".format
_VAR = "'(?s)window\\.(" + "|".join(S.WINDOW_VARS) + ")\\s*=\\s*(\\{.*\\})\\s*;?\\s*$'"
_PAYLOADS = rf"""(
    WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, {_TAG})) AS tag, generate_subscripts(regexp_extract_all(html, {_TAG}), 1) - 1 AS ord FROM {PAGES.sql}),
    a AS (SELECT page_id, ord, {_ATTR(f'regexp_extract(tag, {_TAG}, 1)', 'id')} AS name, lower({_ATTR(f'regexp_extract(tag, {_TAG}, 1)', 'type')}) AS kind, regexp_extract(tag, {_TAG}, 1) AS attrs, trim(regexp_extract(tag, {_TAG}, 2)) AS body FROM t),
    s AS (SELECT page_id, ord, CASE WHEN name = '__NEXT_DATA__' THEN 'next_data' WHEN name = '__NUXT_DATA__' THEN 'nuxt_data' WHEN kind = 'application/ld+json' THEN 'ld_json' WHEN kind = 'application/json' AND regexp_matches(attrs, '(?i)\bdata-') THEN 'generic' WHEN kind IN ('', 'text/javascript') AND regexp_matches(body, {_VAR}) THEN 'window_var' END AS source, name, body FROM a),
    p AS (SELECT page_id, ord, source, nullif(CASE WHEN source = 'window_var' THEN regexp_extract(body, {_VAR}, 1) ELSE name END, '') AS script_id, CASE WHEN source = 'window_var' THEN regexp_extract(body, {_VAR}, 2) ELSE body END AS data FROM s WHERE source IS NOT NULL),
    m AS (SELECT page_id, {_ATTR('tag', 'property')} AS k, {_ATTR('tag', 'content')} AS v, i FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), 1) AS i FROM {PAGES.sql})),
    o AS (SELECT page_id, 1048576 AS ord, 'opengraph' AS source, NULL AS script_id, '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY i) || '}}' AS data FROM (SELECT page_id, k, arg_min(v, i) AS v, min(i) AS i FROM m WHERE regexp_matches(k, '(?i)^(og|article|product|book|profile):') GROUP BY page_id, k) GROUP BY page_id)
    SELECT *, strlen(data)::INT AS byte_size FROM (SELECT * FROM p UNION ALL SELECT * FROM o) WHERE (starts_with(data, '{{') OR starts_with(data, '[')) AND TRY_CAST(data AS JSON) IS NOT NULL)"""


@query(f"SELECT page_id, ord::INT AS ord, source, script_id, byte_size, data FROM {_PAYLOADS}")
def ext5_payloads(spark, sf_dir):
    return S.payloads(PAGES.df(spark, sf_dir))


_ENTITIES = f"""(SELECT page_id, ord, source, byte_size, nth - 1 AS nth, e, CASE WHEN json_type(e, '$."@type"') = 'ARRAY' THEN e->>'$."@type"[0]' ELSE e->>'$."@type"' END AS kind FROM (SELECT page_id, ord, source, byte_size, unnest(es) AS e, generate_subscripts(es, 1) AS nth FROM (
    SELECT page_id, ord, source, byte_size, flatten(list_transform(CASE WHEN json_type(data) = 'ARRAY' THEN json_extract(data, '$[*]') ELSE [data::JSON] END, lambda x: CASE WHEN json_type(x, '$."@graph"') = 'ARRAY' THEN json_extract(x, '$."@graph"[*]') ELSE [x] END)) AS es FROM {_PAYLOADS} WHERE source = 'ld_json')) WHERE json_type(e) = 'OBJECT')"""
_STRONG = f"(SELECT page_id, ord, bool_or(kind IN ({', '.join(repr(k) for k in S.STRONG)}) AND len(list_filter(json_keys(e), lambda k: NOT starts_with(k, '@') AND json_type(e, '$.\"' || k || '\"') <> 'NULL' AND json_extract(e, '$.\"' || k || '\"')::VARCHAR NOT IN ('\"\"', '[]', '{{}}'))) >= 3) AS strong, bool_or(kind IN ('Article', 'NewsArticle')) AS prose FROM {_ENTITIES} GROUP BY page_id, ord)"


@query(f"""
    WITH r AS (SELECT p.*, coalesce(strong, false) AS strong, coalesce(prose, false) AS prose FROM {_PAYLOADS} p LEFT JOIN {_STRONG} s ON s.page_id = p.page_id AND s.ord = p.ord),
    b AS (SELECT *, CASE WHEN strong THEN 0 WHEN source IN ('next_data', 'nuxt_data') THEN 2 WHEN source = 'opengraph' THEN 3 WHEN source = 'ld_json' THEN 4 WHEN source = 'window_var' THEN 5 ELSE 6 END AS bucket FROM r)
    SELECT page_id, ord::INT AS ord, bucket, strong, prose, row_number() OVER (PARTITION BY page_id ORDER BY bucket, byte_size DESC, ord)::INT AS place FROM b
""")
def ext6_ext7_ext24_win3_ranked(spark, sf_dir):
    r = S.ranked(S.payloads(PAGES.df(spark, sf_dir)))
    return r.select("page_id", "ord", "bucket", "strong", S.prose_metadata(F.col("source"), F.col("data")).alias("prose"), "place")


#: The texts as a reader would write them down.
_TEXTS = Fixture("pages/6: page_id int, ord int, text string", [
    (0, 0, "## Product: Lamp §\n- **name:** Lamp §\n- **sku:** 12\n- **offers:** price=9.90, priceCurrency=EUR\n- **color:** red, blue\n- **review:**\n  - author=A, stars=4\n  - author=B"),
    (1, 0, "## Store: Shop §\n- **name:** Shop §\n\n## WebSite: S\n- **name:** S\n- **url:** u\n\n## NewsArticle: H\n- **headline:** H\n- **datePublished:** 2024\n- **author:** name=Z"),
    (3, 0, "### ItemList\n\n- [One 1](/1) — 5 TRY ⭐ 4.5\n- [Two](/2) — 7\n- Three"),
    (3, 1, "## Recipe: Soup\n- **name:** Soup\n- **Yield:** 4\n- **Ingredients:** a, b\n- **Instructions:** " + ("Stir. " * 100)[:499].rstrip() + "…"),
    (4, 0, "\n\n".join(f"## Event: E{i}\n- **name:** E{i}" for i in range(12)) + "\n\n_… 5 further structured entities not shown._")])


@query(f"SELECT * FROM {_TEXTS.sql}")
def ext8_ext9_ext10_entity_texts(spark, sf_dir):
    return S.entity_texts(S.payloads(PAGES.df(spark, sf_dir)))


_FLAT = Fixture("pages/6: page_id int, nth int, n long, every string", [
    (0, 0, 8, "name=Lamp §|sku=12|offers.price=9.90|offers.priceCurrency=EUR|color=red; blue|review[0].author=A|review[0].stars=4|review[1].author=B"),
    (4, 16, 1, "list=s")])


@query(f"SELECT * FROM {_FLAT.sql}")
def ext12_flat_fields(spark, sf_dir):
    e = S.payloads(PAGES.df(spark, sf_dir)).where("source = 'ld_json' and page_id % 6 in (0, 4)").select("page_id", F.posexplode(S.entries(F.col("data"))).alias("at", "entity")).where(F.col("page_id") % 6 == 0).unionByName(
        S.payloads(PAGES.df(spark, sf_dir)).where("source = 'ld_json' and page_id % 6 = 4").select("page_id", F.posexplode(S.entries(F.col("data"))).alias("at", "entity")).where("at = 16"))
    flat = S.flat_fields(e.select(F.struct("page_id", "at").alias("id"), "entity")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "key", "value"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("every"))
    return flat.select("id.page_id", F.col("id.at").alias("nth"), "n", "every")


_SUBJECTS = Fixture("pages/6: page_id int, type string, n_fields long, omitted long, first string", [(0, "Product", 8, 0, "name"), (1, "Store", 1, 0, "name"), (3, "Recipe", 4, 0, "name"), (4, "Event", 1, 0, "name")])


@query(f"SELECT * FROM {_SUBJECTS.sql}")
def ext11_agg28_subject_entities(spark, sf_dir):
    pages = PAGES.df(spark, sf_dir).where("page_id % 6 <> 3").union(PAGES.df(spark, sf_dir).where("page_id % 6 = 3").select("page_id", F.regexp_replace("html", "ItemList", "WebPage").alias("html")))
    return S.subject_entities(S.payloads(pages)).select("page_id", "type", "n_fields", "omitted", F.col("fields")[0]["key"].alias("first"))


_COMMERCE = Fixture("pages/6: page_id int, pos int, name string, url string, price string, currency string, rating string, stock string, seller string, line string", [
    (3, 0, "One [1]", "/1", "5", "TRY", "4.5", "InStock", "Me", "- [One 1](/1) — 5 TRY ⭐ 4.5"), (3, 1, "Two", "/2", "7", None, None, "few", None, "- [Two](/2) — 7"), (3, 2, "Three", None, None, None, None, "OutOfStock", "You", "- Three")])


@query(f"SELECT * FROM {_COMMERCE.sql}")
def ext13_ext15_ext20_commerce_rows(spark, sf_dir):
    rows = S.listing_rows(S.payloads(PAGES.df(spark, sf_dir)))
    return rows.select("page_id", "pos", "c.*", S.record_line(F.col("c")).alias("line"))


@query(f"SELECT page_id, true AS shaped, '### ItemList' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM {_COMMERCE.sql} GROUP BY page_id")
def ext14_commerce_lists(spark, sf_dir):
    return S.commerce_lists(S.listing_rows(S.payloads(PAGES.df(spark, sf_dir)))).select("page_id", "shaped", "text")


_WIDE = Fixture("events: id int, rows string", [(0, '[{"a": "1|2", "b": {"x": 1}, "@c": "z"}, {"d": "3", "a": null}]'), (1, "[" + ", ".join('{"k%d": "v%d"}' % (i % 10, i) for i in range(60)) + "]"), (2, '[{"@only": "x"}]'), (3, '[{"long": "' + "y" * 250 + '"}]')])
_BARS = Fixture("events/4: id int, lines int, head string, last string", [(0, 6, "| a | d |", "|  | 3 |"), (1, 56, "| k0 | k1 | k2 | k3 | k4 | k5 | k6 | k7 |", "_Showing 50 of 60 rows — this is a partial view._"), (3, 5, "| long |", "| " + "y" * 200 + " |")])


@query(f"SELECT * FROM {_BARS.sql}")
def ext16_tables(spark, sf_dir):
    rows = F.transform(S.elements(F.col("rows")), lambda x: S.fields(x["value"]))
    made = F.array_compact(F.array(F.split(S.table_text(rows, F.lit("T")), "\n")))
    t = _WIDE.df(spark, sf_dir).select("id", F.explode(made).alias("t"))  # a filter would be moved below and make each table twice
    return t.select("id", F.size("t").alias("lines"), F.col("t")[2].alias("head"), F.element_at("t", -1).alias("last"))


@query("SELECT page_id, '### OpenGraph' || chr(10) || chr(10) || '| property | value |' || chr(10) || '| --- | --- |' || chr(10) || '| og:title | A / lamp |' || chr(10) || '| og:type | product |' AS text FROM pages WHERE page_id % 6 = 0")
def ext18_open_graph(spark, sf_dir):
    return S.payloads(PAGES.df(spark, sf_dir)).where("source = 'opengraph'").select("page_id", S.graph_text(F.col("data")).alias("text"))


_P = "Prose that is long enough to be some. " * 15
_CANDIDATES = Fixture("pages: page_id int, ord int, source string, content string, answer_bearing boolean, prose_metadata boolean", [
    (0, 0, "prose", _P, False, False), (0, 1, "json_synth", "price 9", True, False), (1, 0, "prose", _P, False, False), (1, 1, "json_synth", "headline", False, True), (2, 0, "prose", "thin", False, False), (2, 1, "json_synth", "site name", False, False), (2, 2, "json_synth", "the answer", True, False),
    (3, 0, "prose", "thin", False, False), (3, 1, "json_synth", "one", False, False), (3, 2, "json_synth", "one  two", False, False), (3, 3, "json_synth", "one two", False, False), (4, 0, "prose", _P, False, False), (4, 1, "record_synth", "- row", False, False), (5, 0, "prose", "thin", False, False), (6, 0, "json_synth", "", False, False), (6, 1, "other", "odd", False, False), (7, 0, "prose", _P, False, False), (7, 1, "json_synth", "long enough", False, False)])
_BODIES = Fixture("pages/8: page_id int, body string, menu string", [
    (0, _P + "\n\nprice 9", "## source: prose\n\n" + _P + "\n\n## source: structured (json)\n\nprice 9"), (1, _P, "## source: prose\n\n" + _P + "\n\n## source: structured (json)\n\nheadline"), (2, "the answer", "## source: prose\n\nthin\n\n## source: structured (json)\n\nsite name\n\n## source: structured (json)\n\nthe answer"),
    (3, "one  two", "## source: prose\n\nthin\n\n## source: structured (json)\n\none  two"), (4, "- row", "## source: prose\n\n" + _P + "\n\n## source: structured (records)\n\n- row"), (5, "thin", "## source: prose\n\nthin"), (6, "odd", "## source: other\n\nodd"), (7, _P, "## source: prose\n\n" + _P)])


@query(f"SELECT * FROM {_BODIES.sql}")
def ext4_ext25_ext26_bodies(spark, sf_dir):
    return S.bodies(_CANDIDATES.df(spark, sf_dir))


# Framework state in a page: a list of rows as deep as the page's number says, and a rival beside it: a list on top, or one in the next branch.
_ROWS = """concat('[{"name":"A', page_id, '","url":"/a', page_id, '","price":', page_id, '},{"name":"B"}]')"""
_INNER = f"""concat(repeat('{{"k":', CAST(page_id % 8 AS INT)), '{{"x":[1,{{"items":"no"}}],"items":[],"products":[1,2],"results":', {_ROWS}, '}}', repeat('}}', CAST(page_id % 8 AS INT)))"""
_STATE = f"""CASE page_id % 3 WHEN 0 THEN concat('{{"first":', {_INNER}, ',"list":[{{"name":"R', page_id, '"}}]}}') WHEN 1 THEN concat('{{"first":', {_INNER}, ',"second":{{"items":[{{"name":"S', page_id, '"}}]}}}}') ELSE {_INNER} END"""
_STATED = f"""SELECT page_id, url, concat(html, '<script id="__NEXT_DATA__" type="application/json">', {_STATE}, '</script>') AS html FROM pages"""
_WINS = "CASE WHEN page_id % 3 = 0 THEN 'R' WHEN page_id % 3 = 1 AND page_id % 8 > 5 THEN 'S' WHEN page_id % 8 < 7 THEN 'A' END"
_JOINED = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || '/a' || page_id"


@query(f"""
    SELECT page_id, 'next_data' AS source, '### Listings' || chr(10) || chr(10) || CASE WHEN w = 'A' THEN '- [A' || page_id || '](/a' || page_id || ') — ' || page_id || chr(10) || '- B' ELSE '| name |' || chr(10) || '| --- |' || chr(10) || '| ' || w || page_id || ' |' END AS text
    FROM (SELECT page_id, {_WINS} AS w FROM pages) WHERE w IS NOT NULL
""")
def ext17_ext8_state_texts(spark, sf_dir):
    found = S.payloads(rows(spark, sf_dir, _STATED, "pages"))
    return S.payload_texts(found).where("source = 'next_data'").select("page_id", "source", "text")


@query(f"""
    SELECT page_id, 0 AS pos, w || page_id AS title, CASE WHEN w = 'A' THEN {_JOINED} END AS link, w || page_id || CASE WHEN w = 'A' THEN ' — ' || page_id ELSE '' END AS text FROM (SELECT page_id, url, {_WINS} AS w FROM pages) WHERE w IS NOT NULL
    UNION ALL SELECT page_id, 1, 'B', NULL, 'B' FROM (SELECT page_id, {_WINS} AS w FROM pages) WHERE w = 'A'
""")
def ext20_ext21_state_records(spark, sf_dir):
    pages = rows(spark, sf_dir, _STATED, "pages")
    return S.records_of(S.listing_rows(S.payloads(pages)), pages).select("page_id", "pos", "title", "link", "text")


# Linked data: a trail, a list that is not commerce, and an entity whose texts look like objects.
_LINKED = """concat('[{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"name":"P', page_id, '"},{"x":1},7]},{"@type":"ItemList","itemListElement":[{"item":{"name":"one","size":1,"deep":{"a":1}}},{"name":"two ', page_id, '","ok":true}]},{"@type":"Product","name":"{odd}","ok":false,"n":[null,"a",true],"list":"[1]"}]')"""


@query("""
    SELECT page_id, '**Breadcrumbs:** Home > P' || page_id || chr(10) || chr(10) || '### ItemList' || chr(10) || chr(10) || '| name | size | ok |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| one | 1 |  |' || chr(10) || '| two ' || page_id || ' |  | True |' || chr(10) || chr(10)
        || '## Product: {odd}' || chr(10) || '- **name:** {odd}' || chr(10) || '- **ok:** False' || chr(10) || '- **n:** a, True' || chr(10) || '- **list:** [1]' AS text FROM pages
""")
def ext9_ext10_trails_and_lists(spark, sf_dir):
    pages = rows(spark, sf_dir, f"""SELECT page_id, concat(html, '<script type="application/ld+json">', {_LINKED}, '</script>') AS html FROM pages""", "pages")
    return S.payload_texts(S.payloads(pages)).where("source = 'ld_json'").select("page_id", "text")


_ODD = """concat('{"id":', page_id, ',"tags":["a",{}],"u":"', CASE WHEN page_id % 10 = 0 THEN repeat('x', 25000) ELSE url END, '"}')"""


@query("""
    SELECT page_id, '```json' || chr(10) || CASE WHEN length(t) > 20000 THEN left(t, 20000) || chr(10) || '… (truncated)' ELSE t END || chr(10) || '```' AS text FROM (SELECT page_id, '{' || chr(10) || '  "id": ' || page_id || ',' || chr(10) || '  "tags": [' || chr(10) || '    "a",' || chr(10) || '    {}' || chr(10) || '  ],' || chr(10)
        || '  "u": "' || CASE WHEN page_id % 10 = 0 THEN repeat('x', 25000) ELSE url END || '"' || chr(10) || '}' AS t FROM pages)
""")
def ext19_fenced_answers(spark, sf_dir):
    return rows(spark, sf_dir, f"SELECT page_id, {_ODD} AS data FROM pages", "pages").select("page_id", S.fenced(F.col("data")).alias("text"))
