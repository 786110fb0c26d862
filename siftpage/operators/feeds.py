"""Lists of posts from feeds, linear replies to a topic, and the articles that an encyclopaedia page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.fragments import fragment_markdown
from siftpage.functions.scalars import human_age
from siftpage.functions.texts import partial_note
from siftpage.operators import markup as M
from siftpage.operators.publications import MISSING, NEXT, closed, filled
from siftpage.operators.trees import stored
from siftpage.sources.captured import feed_entries

POSTS, REPLIES = 25, 200  # fixed values: what is shown at most
TOPIC = "title string, content string, content_rendered string, member struct<username:string>"
REPLY = "array<struct<content:string,content_rendered:string,member:struct<username:string>>>"


def post_lists(feeds: DataFrame, now: Column) -> DataFrame:
    """feeds (id, heading, label, body) -> (id, shown, markdown): the posts of a feed that have a title, a line or two each with
    board, author and age. A feed without any gives no text; scores and counts, which feeds do not carry, are not made up."""
    e = feed_entries(feeds.select("id", "body")).where("kind = 't3' and coalesce(title, '') <> ''")
    board = filled(F.regexp_extract("link", r"/r/([^/]+)", 1))
    posted = F.unix_seconds(F.try_to_timestamp("at"))
    age = F.when(posted.isNotNull(), human_age(now - posted))
    meta = F.concat_ws(" · ", F.concat(F.lit("r/"), board), F.concat(F.lit("u/"), "author"), age)
    line = F.concat(F.lit("- **"), F.trim("title"), F.lit("**"), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""), F.coalesce(F.concat(F.lit("\n  <"), filled(F.col("link")), F.lit(">")), F.lit("")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    g = e.select("id", place.alias("place"), line.alias("line")).where(F.col("place") <= POSTS).groupBy("id").agg(F.count(F.lit(1)).alias("shown"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    out = feeds.select("id", "heading", "label").join(g, "id", "left")
    text = closed([F.lit("# "), F.col("heading"), F.lit("\n\n## "), F.col("label"), F.lit(" ("), F.col("shown").cast("string"), F.lit(")\n\n"), F.col("lines")])
    return out.select("id", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), F.when(F.col("shown").isNotNull(), text).alias("markdown"))


def replies(answers: DataFrame) -> DataFrame:
    """answers (id, topic, replies) -> (id, title, byline, came, lost, markdown): a topic and what was answered, one after the other.

    Replies that are null, or no list, did not come, which the text says; none at all add nothing; more than REPLIES are
    counted in a note. A post's own text comes before its markup.
    """
    t = F.from_json("topic", TOPIC)
    is_list = F.coalesce(F.col("replies").startswith("["), F.lit(False))
    own = lambda p: F.coalesce(filled(F.regexp_replace(F.regexp_replace(F.coalesce(p["content"], F.lit("")), r"\r\n?", "\n"), r"^\s+|\s+$", "")), fragment_markdown(F.coalesce(p["content_rendered"], F.lit(""))))
    said = lambda r: F.concat(F.lit("**"), F.coalesce(filled(r["member"]["username"]), F.lit("[unknown]")), F.when(own(r) != "", F.concat(F.lit(":**\n\n"), own(r), F.lit("\n"))).otherwise(":** _[empty]_\n"))
    rows = answers.select("id", t.alias("t"), F.when(is_list, F.from_json("replies", REPLY)).alias("rs"), (~is_list).alias("lost"))
    rows = rows.select("*", F.coalesce(F.size("rs"), F.lit(0)).alias("came"), filled(F.trim("t.title")).alias("title"), filled(F.col("t.member.username")).alias("byline"))
    n = F.least(F.col("came"), F.lit(REPLIES))
    note = partial_note(n, F.col("came"), F.lit("replies"))
    listed = F.concat(F.lit("---\n\n## Replies ("), n.cast("string"), F.lit(")\n\n"), F.when(note != "", F.concat(note, F.lit("\n"))).otherwise(""), F.array_join(F.transform(F.slice("rs", 1, REPLIES), said), "\n"))
    section = F.when(F.col("lost"), F.lit(f"---\n\n## Replies\n\n{MISSING}\n")).when(F.col("came") > 0, listed)
    parts = F.array_compact(F.array(F.concat(F.lit("# "), "title", F.lit("\n")), F.concat(F.lit("by "), "byline", F.lit("\n")), F.concat(filled(own(F.col("t"))), F.lit("\n")), section))
    return rows.select("id", "title", "byline", F.col("came").cast("long").alias("came"), "lost", closed([F.array_join(parts, "\n")]).alias("markdown"))


def article_links(pages: DataFrame) -> DataFrame:
    """pages (page_id, lang, html) of an encyclopaedia -> (page_id, place, anchor, url, reason, kind): the first NEXT articles that a
    page links, each once; pages of other kinds, with a colon in their name, are left out."""
    n = stored(M.nodes(pages))
    a = F.col("attrs")
    bodies = n.where((F.col("tag") == "body") & M.having(a, "mw-parser-output"))
    links = M.inside(n.where((F.col("tag") == "a") & (a["rel"] == "mw:WikiLink")), bodies).select("page_id", "pos", F.regexp_replace(F.substring_index(a["href"], "#", 1), r"^\./", "").alias("target"))
    texts = M.subtree_texts(n, links).where("text <> ''")
    good = links.join(texts, ["page_id", "pos"]).where((F.coalesce("target", F.lit("")) != "") & ~F.contains("target", F.lit(":")))
    once = good.groupBy("page_id", "target").agg(F.min(F.struct("pos", "text")).alias("f"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos")) - 1).where(F.col("place") < NEXT)
    url = F.concat(F.lit("https://"), "lang", F.lit(".wikipedia.org/wiki/"), "target")
    return placed.join(pages.select("page_id", "lang"), "page_id").select("page_id", "place", F.col("f.text").alias("anchor"), url.alias("url"), F.lit("related article").alias("reason"), F.lit("related").alias("kind"))
