"""Registered queries over sites with a reader of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftpage.operators import sites as T
from siftpage.plans.fixtures import Fixture
from siftpage.plans.queries import query

_FORUMS = ["Meta.Discourse.org"]
# (URL, reader, what it asks for)
_URLS = [
    ("https://www.reddit.com/r/x/comments/1ab/a_slug/", "reddit", "https://old.reddit.com/r/x/comments/1ab/a_slug/?limit=500&sort=top"), ("https://old.reddit.com/r/x/comments/1ab", "reddit", "https://old.reddit.com/r/x/comments/1ab/?limit=500&sort=top"), ("https://np.reddit.com/r/x/comments/1ab/slug/c0ffee/", "reddit", "https://old.reddit.com/r/x/comments/1ab/slug/?limit=500&sort=top"),
    ("https://reddit.com/r/x", "reddit", "https://www.reddit.com/r/x/.rss"), ("https://reddit.com/r/x/top/?t=day", "reddit", "https://www.reddit.com/r/x/top.rss"), ("https://reddit.com/r/x/hot", "reddit", "https://www.reddit.com/r/x/.rss"), ("https://www.reddit.com/search/?q=a", "reddit", "https://www.reddit.com/search.rss?q=a"), ("https://www.reddit.com/user/y", None, None), ("https://redd.it/abc", "reddit", None),
    ("https://news.ycombinator.com/item?id=42", "hn", "https://hn.algolia.com/api/v1/items/42"), ("https://news.ycombinator.com/item?id=x", None, None), ("https://news.ycombinator.com/", "hn", None), ("https://news.ycombinator.com/news/", "hn", None), ("https://hn.algolia.com/?q=spark", "hn", None), ("https://hn.algolia.com/?q=", None, None),
    ("https://arxiv.org/abs/2101.00001v2", "arxiv", None), ("https://www.arxiv.org/list/cs.CL/recent", "arxiv", None), ("https://arxiv.org/pdf/2101.00001", None, None), ("https://en.wikipedia.org/wiki/Spark_(x)", "wikipedia", None), ("https://commons.wikipedia.org/wiki/X", None, None), ("https://github.com/a/b", "github", None), ("https://github.com/a/b/issues/3", "github", None), ("https://github.com/Trending/python", None, None), ("https://github.com/a/b/tree/main", None, None),
    ("https://x.com/u/status/12/photo/1", "twitter", None), ("https://x.com/u", None, None), ("https://meta.discourse.org/t/topic-slug/123/7", "discourse", "https://meta.discourse.org/t/topic-slug/123.json"), ("https://meta.discourse.org/latest", "discourse", None), ("https://habr.com/ru/companies/z/articles/77/", "habr", None), ("https://habr.com/ru/news/77", None, None), ("https://v2ex.com/t/99/slug", "v2ex", "https://www.v2ex.com/t/99"), ("https://example.com/t/99", None, None), ("not a url", None, None)]
URLS = Fixture("events: id int, url string, reader string, address string", [(i, *u) for i, u in enumerate(_URLS)])


@query(f"SELECT * FROM {URLS.sql}")
def flt8_url8_readers(spark, sf_dir):
    u = F.col("url")
    return URLS.df(spark, sf_dir).select("id", "url", T.reader(u, _FORUMS).alias("reader"), T.address(u, _FORUMS).alias("address"))


_ATTEMPTS = Fixture("events: id int, seq int, verdict string", [(0, 0, "timeout"), (0, 1, "anti_bot"), (0, 2, "connection_error"), (1, 0, "anti_bot"), (1, 1, "ok"), (2, 0, "not_found"), (2, 1, "timeout")])


@query(f"SELECT id, CASE WHEN bool_or(verdict = 'ok') THEN 'ok' ELSE coalesce(arg_max(verdict, seq) FILTER (WHERE verdict IN ('anti_bot', 'block_page_detected')), arg_max(verdict, seq)) END AS verdict FROM {_ATTEMPTS.sql} GROUP BY id")
def hnd7_mirror_verdicts(spark, sf_dir):
    return T.mirror_verdict(_ATTEMPTS.df(spark, sf_dir))


_SECTIONS = Fixture("events: reader string, section string, came int, left_over int", [("github", "issues", 5, 0), ("github", "pulls", 0, 0), ("hn", "hits", 30, 28)])


@query(f"SELECT reader, section FROM {_SECTIONS.sql} WHERE came > 0 AND left_over = 0")
def hnd11_rotten_sections(spark, sf_dir):
    return T.rotten(_SECTIONS.df(spark, sf_dir).withColumnRenamed("left_over", "left"))


_NODES = Fixture("pages: page_id int, pos int, tag string, txt string", [(0, 0, "dt", "[1]"), (0, 1, "dd", "one"), (0, 2, "dt", "[2]"), (0, 3, "dt", "[3]"), (0, 4, "dd", "three"), (0, 5, "dd", "more"), (1, 0, "dd", "stray")])


@query(f"SELECT page_id, pos, txt AS term, d AS definition FROM (SELECT *, lead(tag) OVER w AS t, lead(txt) OVER w AS d FROM {_NODES.sql} WINDOW w AS (PARTITION BY page_id ORDER BY pos)) WHERE tag = 'dt' AND t = 'dd'")
def jon12_definitions(spark, sf_dir):
    return T.definitions(_NODES.df(spark, sf_dir).withColumnRenamed("txt", "text"))
