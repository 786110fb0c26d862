"""Registered queries over pages as nodes, with the rows a reader of the markup would write down."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import markup as M
from siftpage.operators import structured as S
from siftpage.operators.trees import stored
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query, table
from siftpage.plans.retrieval import rows

_HTML = [
    '<html><head><title> The  Title § </title><meta property="og:title" content="OG §"><meta name="author" content="Ann"><meta name="author" content="Bob"><meta property="article:published_time" content="2018-01-01"><script>var p = "<p>no</p>";</script></head><body><nav><p>menu <a href="/m">m</a></p></nav><h1>Head &amp; more</h1><p>One <a href="/x">link <b>bold</b></a> end.<p>Two<ul><li>a<li>b</ul><blockquote>said</blockquote><time datetime="2020-03-04T05:00">then</time><footer><p>foot</p></footer></body></html>',
    "<div class='list'>" + "".join(f"<div class='card x'><h3><a href='/i{i}'>Item § {i}</a></h3><span>price {i}</span></div>" for i in range(4)) + "</div><ul class='menu'><li class='m'>a</li></ul>",
    "<div role=tablist><button role=tab aria-controls=p1 aria-selected=true>Info</button><button role=tab aria-controls=p2>Reviews (12)</button><button role=tab aria-controls=p3>Specs</button><button role=tab>Loose § 3</button></div><div id=p1></div><div id=p2> </div><div id=p3>filled</div><nav><button role=tab>Nav</button></nav><details><summary>More</summary></details><details><summary>Full</summary>body</details><details open><summary>Open</summary></details><details><summary>Reviews 7</summary></details>",
    "<table class=t><tr><td class=n>one</td><td class=v>1 <i>x</i></td></tr><tr><td class=n>two</td></tr></table>",
    "<table class=t></table>", "<p>none</p>", "<table class=t><tr><th>changed</th></tr></table>", None]
PAGES = Fixture("pages: page_id long, html string", list(enumerate(_HTML)))


def _nodes(spark, sf_dir, *cases):
    p = PAGES.df(spark, sf_dir)
    return M.nodes(p.where((F.col("page_id") % 8).isin(*cases)))


_ARTICLE = Fixture("pages/8: page_id long, title string, markdown string, headings string", [(0, "The Title §", "# Head & more\n\nOne [link](/x) [bold](/x) end.\n\nTwo\n\n- a\n\n- b\n\n> said", "1 Head & more")])


@query(f"SELECT * FROM {_ARTICLE.sql}")
def ext1_ext29_articles(spark, sf_dir):
    return M.articles(_nodes(spark, sf_dir, 0)).withColumn("headings", F.array_join("headings", "|"))


@query("SELECT page_id, 'Ann' AS author, 'OG p' || page_id AS title, DATE '2020-03-04' AS published FROM pages WHERE page_id % 8 = 0")
def ext2_ext3_metadata(spark, sf_dir):
    n = _nodes(spark, sf_dir, 0)
    m = M.metadata(n).groupBy("page_id").agg(F.max(F.when(F.col("key") == "author", F.col("value"))).alias("author"), F.max(F.when(F.col("key") == "og.title", F.col("value"))).alias("title"))
    return m.join(M.published(n), "page_id")


_RECORDS = Fixture("pages/8: page_id long, nth int, signature string, heading string, href string, text string", [(1, i, "div.card", f"Item § {i}", f"/i{i}", f"Item § {i} price {i}") for i in range(4)])


@query(f"SELECT * FROM {_RECORDS.sql}")
def ext22_records(spark, sf_dir):
    from pyspark.sql import Window

    r = M.records(_nodes(spark, sf_dir, 0, 1, 5))
    return r.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("nth"), "signature", "heading", "href", "text")


@query("SELECT page_id, string_agg('- [Item p' || page_id || ' ' || i || '](/i' || i || ') price ' || i, chr(10) ORDER BY i) AS text FROM pages, range(4) t(i) WHERE page_id % 8 = 1 GROUP BY page_id")
def ext23_record_texts(spark, sf_dir):
    return M.record_texts(M.records(_nodes(spark, sf_dir, 0, 1, 5)))


_GATES = Fixture("pages/8: page_id long, handle int, label string, stated_count int", [(2, 1, "Reviews", 12), (2, 2, "Loose §", 3), (2, 3, "More", None)])


@query(f"SELECT * FROM {_GATES.sql}")
def ext28_gated_sections(spark, sf_dir):
    return M.gated_sections(_nodes(spark, sf_dir, 2, 5))


_DECLARED = Fixture("pages/8: page_id long, verdict string, name string, val string", [(3, "OK", "one", "1 x"), (3, "OK", "two", None), (4, "EMPTY", None, None), (5, "ROT", None, None), (6, "ROT", None, None)])


@query(f"SELECT * FROM {_DECLARED.sql}")
def ext30_declared_rows(spark, sf_dir):
    d = M.declared_rows(_nodes(spark, sf_dir, 3, 4, 5, 6), "table.t", "tr", {"name": "td.n", "val": "td.v"})
    return d.select("page_id", "verdict", F.try_element_at("fields", F.lit("name")).alias("name"), F.try_element_at("fields", F.lit("val")).alias("val"))


@query(r"SELECT page_id, (len(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '(?i)<a[\s>]')))::BIGINT AS links FROM pages")
def ext29_nodes_of_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    links = M.nodes(p).where("tag = 'a'").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return p.select("page_id").join(links, "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


# Items declared by attributes, put into pages: one with an offer and repeated names, two with a property outside of any, one four levels deep, none.
_ITEMS = """CASE page_id % 4 WHEN 0 THEN concat('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">Lamp <i>', page_id, '</i></b><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="', page_id, '.50"><link itemprop="availability" href="https://schema.org/InStock"></div><p itemprop="color">red</p><p itemprop="color alt">blue "x"</p><time itemprop="released" datetime="2024-01-02">then</time></div>')
    WHEN 1 THEN concat('<span itemprop="stray">no</span><div itemscope><a itemprop="url" href="/p', page_id, '">x</a></div><section><div itemscope itemtype="https://schema.org/Event/"></div></section>')
    WHEN 2 THEN concat('<div itemscope itemtype="A"><div itemprop="b" itemscope itemtype="B"><div><div itemprop="c" itemscope itemtype="C"><div itemprop="d" itemscope itemtype="D"><img itemprop="e" src="i', page_id, '.png"></div></div></div></div><div itemprop="b" itemscope></div></div>') ELSE '' END"""
_ITEM_PAGES = f"SELECT page_id, concat('<html><body>', {_ITEMS}, '<p>', page_id, '</p></body></html>') AS html FROM pages"
_DATA = """SELECT page_id, unnest(CASE page_id % 4 WHEN 0 THEN ['{"@type":"Product","name":"Lamp ' || page_id || '","offers":{"@type":"Offer","price":"' || page_id || '.50","availability":"https://schema.org/InStock"},"color":["red","blue \\"x\\""],"alt":"blue \\"x\\"","released":"2024-01-02"}']
    WHEN 1 THEN ['{"url":"/p' || page_id || '"}', '{"@type":"Event"}'] WHEN 2 THEN ['{"@type":"A","b":[{"@type":"B","c":{"@type":"C","d":{"@type":"D","e":"i' || page_id || '.png"}}},{}]}'] ELSE [] END) AS data FROM pages"""


@query(f"SELECT page_id, 'microdata' AS source, strlen(data)::INT AS byte_size, data FROM ({_DATA})")
def ext5_microdata(spark, sf_dir):
    return M.microdata(stored(M.nodes(rows(spark, sf_dir, _ITEM_PAGES, "pages")))).select("page_id", "source", "byte_size", "data")


@query("""
    SELECT page_id, true AS strong, 1 AS bucket, '## Product: Lamp ' || page_id || chr(10) || '- **name:** Lamp ' || page_id || chr(10) || '- **offers:** price=' || page_id || '.50, availability=https://schema.org/InStock' || chr(10) || '- **color:** red, blue "x"' || chr(10) || '- **alt:** blue "x"' || chr(10) || '- **released:** 2024-01-02' AS text, 'name,offers.price,offers.availability,color,alt,released' AS keys FROM pages WHERE page_id % 4 = 0
""")
def ext5_ext6_ext7_ext11_declared_items(spark, sf_dir):
    found = M.microdata(stored(M.nodes(rows(spark, sf_dir, _ITEM_PAGES, "pages").where("page_id % 4 = 0"))))
    ranked = S.ranked(found).select("page_id", "strong", "bucket").join(S.payload_texts(found).select("page_id", "text"), "page_id")
    return ranked.join(S.subject_entities(found).select("page_id", F.array_join(F.transform("fields", lambda f: f["key"]), ",").alias("keys")), "page_id")


# Old thread pages: a thread with answers within answers, removed and without author, no thread, a post without its parts, boxes without bodies.
_BOX = """<div class="thing {1} comment"><div class="entry"><p><a class="author">{0}</a>{2}</p><div class="usertext-body"><div class="md">{3}</div></div></div><div class="child">{4}</div></div>""".format
_POST = """'<div class="thing link" data-subreddit="spark" data-score="77"><div class="entry"><a class="title" href="/x">Thread ', page_id, '</a> by <a class="author">op</a> <a class="comments" href="/c">1,204 comments</a><div class="usertext-body"><div class="md"><p>Post <a href="/y">', page_id, '</a></p></div></div></div></div>'"""
_TREE = _BOX("ann", "id-1", '<span class="score unvoted" title="12">12 points</span>', "<p>one</p><p>more &amp; more</p>", _BOX("", "id-2", '<span class="score unvoted">3 points</span>', "<p>two</p>", '<div class="thing comment"><div class="entry"><a class="more">load more</a></div></div>' + _BOX("cy", "noncollapsed", '<span class="score">[score hidden]</span>', "three", ""))) + _BOX("dee", "", "", "four", "")
_EMPTY_BOX = '<div class="thing comment"><div class="entry"><a class="more">load more</a></div></div>'
_THREADS = f"""SELECT page_id, concat('<html><body>', CASE page_id % 4 WHEN 0 THEN concat({_POST}, '<div class="commentarea">{_TREE}</div>') WHEN 1 THEN '<p>none</p>' WHEN 2 THEN '<div class="thing link"><span class="other">changed</span></div>' ELSE concat({_POST}, '{_EMPTY_BOX}') END, '</body></html>') AS html FROM pages"""
_NL = "|| chr(10) ||"


@query(f"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' ELSE 'rot' END AS verdict, CASE WHEN page_id % 4 <> 2 THEN 'Thread ' || page_id END AS title, CASE WHEN page_id % 4 <> 2 THEN 1204 END AS total, CASE page_id % 4 WHEN 0 THEN 5 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS boxes, CASE WHEN page_id % 4 = 0 THEN 4 ELSE 0 END::BIGINT AS parsed,
        CASE WHEN page_id % 4 = 0 THEN '# Thread ' || page_id {_NL} chr(10) || 'by u/op · in r/spark · 77 points' {_NL} chr(10) || 'Post [' || page_id || '](/y)' {_NL} chr(10) || '---' {_NL} chr(10) || '## Comments (4 of 1204)' {_NL} chr(10) || '_Top-ranked sample from old.reddit, scored and nested._' {_NL} chr(10)
        || '> one' {_NL} '>' {_NL} '> more & more' {_NL} '>' {_NL} '> — u/ann (12 points)' {_NL} chr(10) || '> > two' {_NL} '> >' {_NL} '> > — u/[deleted] (3 points)' {_NL} chr(10) || '> > > three' {_NL} '> > >' {_NL} '> > > — u/cy' {_NL} chr(10) || '> four' {_NL} '>' {_NL} '> — u/dee' || chr(10) END AS markdown
    FROM pages WHERE page_id % 4 <> 1
""")
def hnd2_old_threads(spark, sf_dir):
    posts, comments = M.old_threads(rows(spark, sf_dir, _THREADS, "pages"))
    return posts.join(M.old_thread_texts(posts, comments), "page_id", "left").select("page_id", "verdict", "title", "total", "boxes", "parsed", "markdown")
