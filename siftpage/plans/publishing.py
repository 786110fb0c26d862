"""Registered queries over repositories and papers, whose answers are put together from rows of pages by expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import feeds as D
from siftpage.operators import publications as P
from siftpage.plans.queries import query
from siftpage.plans.retrieval import rows

# Of page k the parts of a repository: every third has no README, of every fourth a list did not come, of every fifth it came as something else; and the issues of every sixth are all pull requests.
_ANSWERS = """SELECT page_id AS id, 'own' AS owner, concat('r', page_id) AS repo, part, CASE part
    WHEN 'meta' THEN concat('{"full_name":"own/r', page_id, '","description":', CASE WHEN page_id % 2 = 0 THEN '"About"' ELSE 'null' END, ',"stargazers_count":', page_id, ',"language":"Scala","license":', CASE WHEN page_id % 2 = 0 THEN '{"name":"MIT"}' ELSE 'null' END, ',"owner":{"login":"own"}}')
    WHEN 'readme' THEN CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 7 = 1 THEN '{"content":"x","encoding":"none"}' ELSE concat('{"encoding":"base64","content":"', {64}, '\\\\n"}') END
    WHEN 'issues' THEN CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 6 = 1 THEN '[{"title":"p","number":1,"pull_request":{"u":1}}]' ELSE concat('[{"title":" I', page_id, ' ","number":7,"comments":3},{"title":"","number":8},{"title":"P","number":9,"pull_request":{"u":1}},{"title":"J","number":10}]') END
    ELSE CASE WHEN page_id % 5 = 0 THEN '{"message":"no"}' ELSE '[]' END END AS payload FROM pages LATERAL VIEW explode(array('meta', 'readme', 'issues', 'pulls')) p AS part"""
_README = "concat('Read ', page_id, ' ü')"


def _repositories(spark, sf_dir):
    return rows(spark, sf_dir, _ANSWERS.replace("{64}", f"base64(encode({_README}, 'UTF-8'))"), "pages")


@query("""
    SELECT page_id AS id, 'own/r' || page_id AS title, 'own' AS byline, array_to_string(list_filter([CASE WHEN page_id % 3 = 0 THEN 'README' END, CASE WHEN page_id % 4 = 0 THEN 'open issues' END, CASE WHEN page_id % 5 = 0 THEN 'open pull requests' END], lambda x: x IS NOT NULL), ',') AS lost,
        array_to_string(list_filter([CASE WHEN page_id % 3 <> 0 AND page_id % 7 = 1 THEN 'README' END, CASE WHEN page_id % 4 <> 0 AND page_id % 6 = 1 THEN 'open issues' END], lambda x: x IS NOT NULL), ',') AS rotten,
        '# own/r' || page_id || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'About' || chr(10) ELSE '' END || '**★ ' || page_id || '** | **Forks 0** | **Language** Scala' || CASE WHEN page_id % 2 = 0 THEN ' | **License** MIT' ELSE '' END || chr(10)
        || CASE WHEN page_id % 3 = 0 THEN chr(10) || '---' || chr(10) || chr(10) || '## README' || chr(10) || chr(10) || '_(this section was NOT retrieved — treat as unknown, not as empty)_' || chr(10) WHEN page_id % 7 = 1 THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) || '## README' || chr(10) || chr(10) || 'Read ' || page_id || ' ü' || chr(10) END AS markdown FROM pages
""")
def hnd5_repositories(spark, sf_dir):
    return P.repositories(_repositories(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("lost", "rotten")})


@query("""
    SELECT page_id AS id, u.place::INT AS place, u.anchor, 'https://github.com/own/r' || page_id || '/issues/' || u.number AS url, 'issue · ' || u.n || ' comments' AS reason, 'related' AS kind
    FROM pages, (SELECT unnest([{'place': 0, 'number': 7, 'n': 3}, {'place': 1, 'number': 10, 'n': 0}]) AS x), LATERAL (SELECT x.place AS place, x.number AS number, x.n AS n, CASE WHEN x.number = 7 THEN 'I' || page_id ELSE 'J' END AS anchor) u WHERE page_id % 4 <> 0 AND page_id % 6 <> 1
""")
def hnd13_repository_links(spark, sf_dir):
    return P.repository_links(_repositories(spark, sf_dir))


_THREAD = """SELECT page_id AS id, 'own' AS owner, 'r' AS repo, part, CASE part WHEN 'meta' THEN concat('{"number":', page_id, ',"title":', CASE WHEN page_id % 2 = 0 THEN '"Bug"' ELSE '""' END, ',"state":"closed","user":{"login":"ann"},"body":"It fails"}')
    WHEN 'comments' THEN CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '[{"user":{"login":"bob"},"body":"Yes"},{"user":null,"body":""},{"body":"No"}]' END
    ELSE CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[{"user":{"login":"cy"},"state":"APPROVED"},{"user":{"login":"di"},"state":"COMMENTED","body":"Hm"}]' ELSE '[]' END END AS payload FROM pages LATERAL VIEW explode(array('meta', 'comments', 'reviews')) p AS part"""
_GONE = "'_(this section was NOT retrieved — treat as unknown, not as empty)_'"


@query(f"""
    SELECT page_id AS id, 'Pull #' || page_id || ': ' || CASE WHEN page_id % 2 = 0 THEN 'Bug' ELSE '(untitled)' END AS title, 'ann' AS byline, CASE WHEN page_id % 12 = 0 THEN 'reviews,comments' WHEN page_id % 4 = 0 THEN 'reviews' WHEN page_id % 3 = 0 THEN 'comments' ELSE '' END AS lost,
        '# Pull #' || page_id || ': ' || CASE WHEN page_id % 2 = 0 THEN 'Bug' ELSE '(untitled)' END || chr(10) || '**State:** closed | **Author:** ann' || chr(10) || chr(10) || 'It fails' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Comments' || chr(10)
        || CASE page_id % 3 WHEN 0 THEN chr(10) || {_GONE} || chr(10) WHEN 2 THEN chr(10) || '**bob:**' || chr(10) || chr(10) || 'Yes' || chr(10) || chr(10) || '**:**' || chr(10) || chr(10) || 'No' || chr(10) ELSE '' END
        || CASE page_id % 4 WHEN 0 THEN chr(10) || '## Reviews' || chr(10) || chr(10) || {_GONE} || chr(10) WHEN 1 THEN chr(10) || '## Reviews' || chr(10) || chr(10) || '**cy** (APPROVED)' || chr(10) || chr(10) || '**di** (COMMENTED):' || chr(10) || chr(10) || 'Hm' || chr(10) ELSE '' END AS markdown FROM pages
""")
def hnd5_pull_requests(spark, sf_dir):
    return P.issues(rows(spark, sf_dir, _THREAD, "pages"), "Pull").withColumn("lost", F.array_join("lost", ","))


_FEEDS = """SELECT page_id AS id, CASE WHEN page_id % 4 = 3 THEN '<feed xmlns="http://www.w3.org/2005/Atom"></feed>' ELSE concat('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title><opensearch:totalResults>', page_id, '</opensearch:totalResults><entry><id>i</id><title>On
   things ', page_id, '</title><summary> Some &amp; more </summary><author><name>A  B</name><arxiv:affiliation>U</arxiv:affiliation></author><author><name>C</name></author><arxiv:comment>no</arxiv:comment><category term="cs.DB" scheme="s"/><category term="cs.CL"/></entry><entry><title>Two</title></entry></feed>') END AS payload FROM pages"""


@query("""
    SELECT page_id AS id, 0 AS pos, 'On things ' || page_id AS title, 'A B, C' AS byline, 'cs.DB,cs.CL' AS categories, '# On things ' || page_id || chr(10) || chr(10) || '_A B, C_' || chr(10) || chr(10) || 'Some & more' || chr(10) || chr(10) || chr(10) || '## Categories' || chr(10) || chr(10) || '- cs.DB' || chr(10) || '- cs.CL' || chr(10) AS markdown, page_id AS total FROM pages WHERE page_id % 4 <> 3
    UNION ALL SELECT page_id, 1, 'Two', NULL, '', '# Two' || chr(10), page_id FROM pages WHERE page_id % 4 <> 3
""")
def hnd4_papers(spark, sf_dir):
    return P.papers(rows(spark, sf_dir, _FEEDS, "pages")).withColumn("categories", F.array_join("categories", ","))


_PAPER = """'<dt><a name=x>[1]</a><a href ="/abs/', 2401, '.', {0}, '" title=\\'Abstract\\'>arXiv</a></dt><dd><div class="meta"><div class=\\'list-title mathjax\\'><span>Title:</span> Paper ', {0}, '</div><div class="list-authors">Authors: <a>A</a>, <a>B', page_id, '</a></div></div></dd>'"""
_LISTING = f"""SELECT page_id, 'cs.DB' AS subject, 'new' AS span, concat('<html><body><h1>Total of 408 entries</h1>', CASE page_id % 4 WHEN 0 THEN concat('<dl id="articles">', {_PAPER.format(1)}, '<dt>[2]</dt><dd><div class="list-title">Title: no address</div></dd>', {_PAPER.format(3)}, '</dl>') WHEN 1 THEN '<dl id="articles"></dl>' WHEN 2 THEN '<dl id="articles"><dt><a href="/x">c</a></dt><dd><p class="changed">t</p></dd></dl>' ELSE '<dl id="other"></dl>' END, '</body></html>') AS html FROM pages"""


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'EMPTY' ELSE 'ROT' END AS verdict, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS shown, 408 AS total, CASE WHEN page_id % 4 < 2 THEN '# arXiv · cs.DB · new' || chr(10) || chr(10) || '## Papers (' || CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END || ' of 408)' || chr(10) || chr(10) || '_Showing ' || CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END || ' of 408 entries the page advertises — this is a partial view._' || chr(10)
        || CASE WHEN page_id % 4 = 0 THEN chr(10) || '- **Paper 1** (A , B' || page_id || ')' || chr(10) || '  <https://arxiv.org/abs/2401.1>' || chr(10) || '- **Paper 3** (A , B' || page_id || ')' || chr(10) || '  <https://arxiv.org/abs/2401.3>' || chr(10) ELSE '' END END AS markdown FROM pages
""")
def hnd4_paper_listings(spark, sf_dir):
    return P.paper_listings(rows(spark, sf_dir, _LISTING, "pages"))[0]


@query("SELECT page_id, i AS place, 'Paper ' || (1 + 2 * i) AS anchor, 'https://arxiv.org/abs/2401.' || (1 + 2 * i) AS url, 'A , B' || page_id AS reason, 'drilldown' AS kind FROM pages, (SELECT unnest([0, 1]) AS i) WHERE page_id % 4 = 0")
def hnd13_paper_links(spark, sf_dir):
    return P.paper_listings(rows(spark, sf_dir, _LISTING, "pages"))[1]


_POSTS = """SELECT page_id AS id, concat('Search: q', page_id) AS heading, 'Results' AS label, CASE page_id % 5 WHEN 4 THEN 'no feed' WHEN 3 THEN '<feed><title>t</title></feed>' ELSE concat('<feed><title>t</title>', repeat(concat('<entry><author><name>/u/al</name></author><id>t3_a</id><link href="https://r.com/r/spark/comments/', page_id, '"/><updated>2024-01-02T00:00:00+00:00</updated><title> Post ', page_id, ' </title></entry>'), CAST(page_id % 30 AS INT)), '<entry><id>t1_c</id><title>comment</title></entry><entry><id>t3_b</id><title></title></entry><entry><id>t3_d</id><title>Bare</title></entry></feed>') END AS body FROM pages"""


@query("""
    WITH p AS (SELECT page_id AS id, least(page_id % 30, 25) AS n, page_id % 30 < 25 AS bare FROM pages WHERE page_id % 5 < 3)
    SELECT page_id AS id, coalesce(n + bare::INT, 0) AS shown, CASE WHEN n IS NOT NULL THEN '# Search: q' || page_id || chr(10) || chr(10) || '## Results (' || (n + bare::INT) || ')' || chr(10) || chr(10)
        || repeat('- **Post ' || page_id || '** (r/spark · u/al · 2d)' || chr(10) || '  <https://r.com/r/spark/comments/' || page_id || '>' || chr(10), n::INT) || CASE WHEN bare THEN '- **Bare**' || chr(10) ELSE '' END END AS markdown FROM pages LEFT JOIN p ON id = page_id
""")
def hnd1_post_lists(spark, sf_dir):
    return D.post_lists(rows(spark, sf_dir, _POSTS, "pages"), F.lit(1704153600 + 2 * 86400))


_REPLIED = """SELECT page_id AS id, concat('{"title":"T', page_id, '","content":" raw\\\\r\\\\ntext ","member":{"username":"ann"}}') AS topic, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE concat('[', repeat('{"content":"same","member":{"username":"bo"}},', CAST(CASE WHEN page_id % 4 = 2 THEN 0 ELSE 210 END AS INT)), '{"content":"","content_rendered":"<p>b<br>c</p>"},{"member":{"username":""}}]') END AS replies FROM pages"""


@query("""
    SELECT page_id AS id, 'T' || page_id AS title, 'ann' AS byline, CASE page_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 212 ELSE 0 END::BIGINT AS came, page_id % 4 = 0 AS lost, '# T' || page_id || chr(10) || chr(10) || 'by ann' || chr(10) || chr(10) || 'raw' || chr(10) || 'text' || chr(10)
        || CASE page_id % 4 WHEN 0 THEN chr(10) || '---' || chr(10) || chr(10) || '## Replies' || chr(10) || chr(10) || '_(this section was NOT retrieved — treat as unknown, not as empty)_' || chr(10) WHEN 1 THEN ''
            WHEN 2 THEN chr(10) || '---' || chr(10) || chr(10) || '## Replies (2)' || chr(10) || chr(10) || '**[unknown]:**' || chr(10) || chr(10) || 'b' || chr(10) || 'c' || chr(10) || chr(10) || '**[unknown]:** _[empty]_' || chr(10)
            ELSE chr(10) || '---' || chr(10) || chr(10) || '## Replies (200)' || chr(10) || chr(10) || '_Showing 200 of 212 replies — this is a partial view._' || chr(10) || chr(10) || array_to_string(list_transform(range(200), lambda i: '**bo:**' || chr(10) || chr(10) || 'same' || chr(10)), chr(10)) END AS markdown FROM pages
""")
def hnd10_replies(spark, sf_dir):
    return D.replies(rows(spark, sf_dir, _REPLIED, "pages"))


_WIKI = """SELECT page_id, 'en' AS lang, concat('<html><body class="mw-body mw-parser-output">', repeat('<a rel="mw:WikiLink" href="./Same#x">Same</a>', 3), '<a rel="mw:WikiLink" href="./File:X">f</a><a rel="mw:WikiLink" href="./Empty"> </a><a href="./Other">o</a><a rel="mw:WikiLink" href="./P', page_id, '">P <i>', page_id, '</i></a>', CASE WHEN page_id % 2 = 0 THEN concat_ws('', transform(sequence(1, 12), i -> concat('<a rel="mw:WikiLink" href="./N', i, '">n</a>'))) ELSE '' END, '</body></html>') AS html FROM pages"""


@query("""
    SELECT page_id, i AS place, CASE i WHEN 0 THEN 'Same' WHEN 1 THEN 'P ' || page_id ELSE 'n' END AS anchor, 'https://en.wikipedia.org/wiki/' || CASE i WHEN 0 THEN 'Same' WHEN 1 THEN 'P' || page_id ELSE 'N' || (i - 1) END AS url, 'related article' AS reason, 'related' AS kind FROM pages, (SELECT unnest(range(10))::INT AS i) WHERE i < 2 OR page_id % 2 = 0
""")
def hnd6_hnd13_article_links(spark, sf_dir):
    return D.article_links(rows(spark, sf_dir, _WIKI, "pages"))
