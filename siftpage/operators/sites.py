"""Which site's own reader takes a URL, and the addresses such readers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.operators.links import hostname, path, query_string

# Hosts and paths of sites with a reader of their own, and the readers' order.
REDDIT, GITHUB, ARXIV, TWITTER, HABR, V2EX = ["reddit.com", "www.reddit.com", "old.reddit.com", "np.reddit.com"], ["github.com", "www.github.com"], ["arxiv.org", "www.arxiv.org"], ["x.com", "www.x.com", "twitter.com", "www.twitter.com"], ["habr.com", "www.habr.com"], ["v2ex.com", "www.v2ex.com"]
RESERVED = "about account apps codespaces collections contact customer-stories dashboard enterprise explore features issues join login logout marketplace new notifications orgs pricing pulls readme search security settings sponsors stars topics trending watching".split()
PRIORITY = {"reddit": 90, "hn": 80, "arxiv": 70, "wikipedia": 60, "github": 50, "twitter": 40, "discourse": 30, "habr": 20, "v2ex": 10}
REDDIT_SEARCH, REDDIT_COMMENTS, REDDIT_LISTING = r"^(/r/[^/]+)?/search/?$", r"^/r/[^/]+/comments/[^/]+(/|$)", r"^/r/([^/]+)(?:/(top|hot|new|rising|best|controversial))?/?$"
REDDIT_PERMALINK = r"^/r/[^/]+/comments/[^/]+/[^/]+/[a-z0-9]{1,12}/?$"
REDDIT_THREAD = r"^/r/([^/]+)/comments/([^/]+)(?:/([^/]+))?"


def _parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("&"), query_string(url)), rf"&{name}=([^&]*)", 1)


def reddit_shape(p: Column) -> Column:
    return F.when(p.rlike(REDDIT_SEARCH), "search").when(p.rlike(REDDIT_COMMENTS), F.when(p.rlike(REDDIT_PERMALINK), "permalink").otherwise("comments")).when(p.rlike(REDDIT_LISTING), "listing")


def claims(url: Column, forums: list[str]) -> dict[str, Column]:
    """For each reader whether it takes the URL."""
    h, p = hostname(url), path(url)
    repo = p.rlike(r"^/[^/]+/[^/]+?/?$") & ~F.lower(F.regexp_extract(p, "^/([^/]+)/", 1)).isin(RESERVED)
    return {
        "reddit": (h.isin(REDDIT) & reddit_shape(p).isNotNull()) | ((h == "redd.it") & (F.length(p) > 1)),
        "hn": ((h == "hn.algolia.com") & (F.trim(F.try_url_decode(_parameter(url, "q"))) != "")) | ((h == "news.ycombinator.com") & (p.isin("", "/", "/news", "/news/") | ((p == "/item") & _parameter(url, "id").rlike(r"^\d+$")))),
        "arxiv": h.isin(ARXIV) & (p.rlike(r"(?i)^/abs/[^/?#]+?(?:v\d+)?/?$") | p.rlike(r"(?i)^/list/[A-Za-z][A-Za-z.-]*/(\d{4,6}|recent|new)/?$")),
        "wikipedia": h.rlike(r"^[a-z]{2,3}\.wikipedia\.org$") & p.rlike("^/wiki/[^?#]+$"),
        "github": h.isin(GITHUB) & (p.rlike(r"^/[^/]+/[^/]+/(issues|pull)/\d+/?$") | repo),
        "twitter": h.isin(TWITTER) & p.rlike(r"^/[^/]+/status/\d+(/.*)?$"),
        "discourse": h.isin([f.lower() for f in forums]) if forums else F.lit(False),
        "habr": h.isin(HABR) & p.rlike(r"(?i)^/(?:(ru|en)/)?(companies/[^/]+/articles|company/[^/]+/blog|articles|post)/\d+/?$"),
        "v2ex": h.isin(V2EX) & p.rlike(r"^/t/\d+(/.*)?$"),
    }


def reader(url: Column, forums: list[str]) -> Column:
    """The reader of the highest priority that takes the URL; null for none."""
    each = claims(url, forums)
    return F.coalesce(*(F.when(each[n], F.lit(n)) for n in sorted(each, key=lambda n: -PRIORITY[n])))


def address(url: Column, forums: list[str]) -> Column:
    """What a reader asks for instead of the URL: a feed, an old form of a thread, an API's answer, an abstract."""
    p, h = path(url), hostname(url)
    shape = reddit_shape(p)
    feed = F.lit("https://www.reddit.com")
    sort = F.regexp_extract(p, REDDIT_LISTING, 2)
    listing = F.concat(feed, F.lit("/r/"), F.regexp_extract(p, REDDIT_LISTING, 1), F.when(sort.isin("top", "new", "rising", "controversial"), F.concat(F.lit("/"), sort, F.lit(".rss"))).otherwise("/.rss"))
    slug = F.regexp_extract(p, REDDIT_THREAD, 3)
    thread = F.concat(F.lit("https://old.reddit.com/r/"), F.regexp_extract(p, REDDIT_THREAD, 1), F.lit("/comments/"), F.regexp_extract(p, REDDIT_THREAD, 2), F.lit("/"), F.when(slug != "", F.concat(slug, F.lit("/"))).otherwise(""), F.lit("?limit=500&sort=top"))
    search = F.concat(feed, F.regexp_replace(p, "/+$", ""), F.lit(".rss"), F.when(query_string(url) != "", F.concat(F.lit("?"), query_string(url))).otherwise(""))
    reddit = F.when(shape.isin("comments", "permalink"), thread).when(shape == "listing", listing).when(shape == "search", search)
    item = F.concat(F.lit("https://hn.algolia.com/api/v1/items/"), _parameter(url, "id"))
    topic = F.regexp_extract(p, r"^/t/(?:([^/]+)/)?(\d+)(?:/\d+)?/?$", 0)
    forum = F.when(topic != "", F.concat(F.lit("https://"), h, F.lit("/t/"), F.when(F.regexp_extract(p, r"^/t/(?:([^/]+)/)?(\d+)", 1) != "", F.concat(F.regexp_extract(p, r"^/t/(?:([^/]+)/)?(\d+)", 1), F.lit("/"))).otherwise(""), F.regexp_extract(p, r"^/t/(?:([^/]+)/)?(\d+)", 2), F.lit(".json")))
    by = reader(url, forums)
    return F.when(by == "reddit", reddit).when((by == "hn") & (p == "/item"), item).when(by == "discourse", forum).when(by == "v2ex", F.concat(F.lit("https://www.v2ex.com/t/"), F.regexp_extract(p, r"^/t/(\d+)", 1)))


def mirror_verdict(attempts: DataFrame) -> DataFrame:
    """attempts (id, seq, verdict) at a site's mirrors -> (id, verdict): ok if any was, a wall seen anywhere, else the last."""
    wall = F.col("verdict").isin("anti_bot", "block_page_detected")
    g = attempts.groupBy("id").agg(F.bool_or(F.col("verdict") == "ok").alias("ok"), F.max_by(F.when(wall, F.col("verdict")), F.when(wall, F.col("seq"))).alias("wall"), F.max_by("verdict", "seq").alias("last"))
    return g.select("id", F.when(F.col("ok"), "ok").otherwise(F.coalesce("wall", "last")).alias("verdict"))


def rotten(sections: DataFrame) -> DataFrame:
    """sections (reader, section, came, left) -> those of which rows came and none was left: the site has changed, it is not empty."""
    return sections.where("came > 0 and left = 0").select("reader", "section")


def definitions(nodes: DataFrame) -> DataFrame:
    """nodes (page_id, pos, tag, text) of a definition list -> (page_id, pos, term, definition), each dt with the dd right after it."""
    w = Window.partitionBy("page_id").orderBy("pos")
    both = nodes.withColumn("next_tag", F.lead("tag").over(w)).withColumn("definition", F.lead("text").over(w))
    return both.where("tag = 'dt' and next_tag = 'dd'").select("page_id", "pos", F.col("text").alias("term"), "definition")
