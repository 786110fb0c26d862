"""Repositories and papers: answers of their sites, some of which may not have come, as tables, texts and onward links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.scalars import listing_total
from siftpage.operators import markup as M
from siftpage.operators.trees import stored

# What stands for a section that did not come, papers and links shown at most, links of each list of a repository.
MISSING = "_(this section was NOT retrieved — treat as unknown, not as empty)_"
PAPERS, NEXT, OF_EACH = 25, 10, 5

REPOSITORY = "full_name string, description string, stargazers_count long, forks_count long, language string, license struct<name:string>, owner struct<login:string>"
ISSUE = "number long, title string, body string, state string, user struct<login:string>"
REMARKS = "array<struct<user:struct<login:string>,body:string,state:string>>"
ROWS = "array<struct<title:string,number:long,comments:long,pull_request:string>>"
FEED = "entry array<struct<id:string,title:string,summary:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>>, `opensearch:totalResults` string"


def closed(parts: list[Column]) -> Column:
    return F.concat(F.regexp_replace(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), r"^\s+|\s+$", ""), F.lit("\n"))


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def answers_of(answers: DataFrame, parts: list[str]) -> DataFrame:
    """answers (id, owner, repo, part, payload) -> (id, owner, repo, and of each part its payload and whether it was lost).

    A part whose payload is null did not come, which is not the same as one that is empty; one that was never asked for is
    neither. Lists that come as anything else count as lost.
    """
    of = lambda p: F.max(F.when(F.col("part") == p, F.col("payload")))
    lost = lambda p: F.bool_or((F.col("part") == p) & F.col("payload").isNull())
    return answers.groupBy("id", "owner", "repo").agg(*(of(p).alias(p) for p in parts), *(F.coalesce(lost(p), F.lit(False)).alias(f"no_{p}") for p in parts))


def listed(part: str, kind: str) -> tuple[Column, Column]:
    """The rows of a part that is a list, and whether it was lost."""
    is_list = F.coalesce(F.col(part).startswith("["), F.lit(False))
    return F.when(is_list, F.from_json(part, kind)), F.col(f"no_{part}") | (F.col(part).isNotNull() & ~is_list)


def repositories(answers: DataFrame) -> DataFrame:
    """answers with parts meta, readme, issues, pulls -> (id, title, byline, lost, rotten, markdown). Only the part meta is needed."""
    a = answers_of(answers, ["meta", "readme", "issues", "pulls"])
    d, readme = F.from_json("meta", REPOSITORY), F.from_json("readme", "content string, encoding string")
    text = F.when(F.lower(readme["encoding"]) == "base64", F.try_to_binary(F.regexp_replace(readme["content"], r"\s", ""), F.lit("base64")).cast("string"))
    issues, no_issues = listed("issues", ROWS)
    pulls, no_pulls = listed("pulls", ROWS)
    rows = a.where("meta is not null").select("id", d.alias("d"), filled(text).alias("readme"), "no_readme", (F.col("readme").isNotNull() & text.isNull()).alias("bad_readme"), issues.alias("issues"), no_issues.alias("no_issues"), pulls.alias("pulls"), no_pulls.alias("no_pulls"))
    count = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(0)).cast("string")
    head = [F.concat(F.lit("# "), F.coalesce(filled(F.col("d.full_name")), F.lit("unknown")), F.lit("\n")), F.concat(filled(F.col("d.description")), F.lit("\n")), F.concat(F.lit("**★ "), count("stargazers_count"), F.lit("** | **Forks "), count("forks_count"), F.lit("** | **Language** "), F.coalesce(filled(F.col("d.language")), F.lit("—"))), F.concat(F.lit(" | **License** "), filled(F.col("d.license.name"))), F.lit("\n")]
    body = F.concat(F.lit("\n---\n\n## README\n\n"), F.coalesce("readme", F.when(F.col("no_readme"), F.lit(MISSING + "\n"))))
    lost = F.array_compact(F.array(F.when(F.col("no_readme"), "README"), F.when(F.col("no_issues"), "open issues"), F.when(F.col("no_pulls"), "open pull requests")))
    shaped = lambda c: F.coalesce((F.size(c) > 0) & (F.size(_proper(F.col(c))) == 0), F.lit(False))
    rotten = F.array_compact(F.array(F.when(F.col("bad_readme"), "README"), F.when(shaped("issues"), "open issues"), F.when(shaped("pulls"), "open pull requests")))
    return rows.select("id", F.coalesce(filled(F.col("d.full_name")), F.lit("unknown")).alias("title"), F.col("d.owner.login").alias("byline"), lost.alias("lost"), rotten.alias("rotten"), closed([*head, body]).alias("markdown"))


def _proper(rows: Column) -> Column:
    """Rows of issues or pull requests that can be pointed at; issues that are pull requests are left to the other list."""
    return F.filter(rows, lambda r: (F.trim(F.coalesce(r["title"], F.lit(""))) != "") & (F.coalesce(r["number"], F.lit(0)) != 0) & r["pull_request"].isNull())


def repository_links(answers: DataFrame) -> DataFrame:
    """(id, place, anchor, url, reason, kind): the first issues and pull requests of a repository."""
    a = answers_of(answers, ["meta", "readme", "issues", "pulls"]).where("meta is not null")
    link = lambda part, path, noun: F.transform(F.slice(_proper(listed(part, ROWS)[0]), 1, OF_EACH), lambda r: F.struct(F.trim(r["title"]).alias("anchor"), F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit(f"/{path}/"), r["number"].cast("string")).alias("url"), F.concat(F.lit(f"{noun} · "), F.coalesce(r["comments"], F.lit(0)).cast("string"), F.lit(" comments")).alias("reason")))
    none = F.array().cast("array<struct<anchor:string,url:string,reason:string>>")
    every = F.slice(F.concat(F.coalesce(link("issues", "issues", "issue"), none), F.coalesce(link("pulls", "pull", "PR"), none)), 1, NEXT)
    return a.select("id", F.posexplode(every).alias("place", "l")).select("id", "place", "l.anchor", "l.url", "l.reason", F.lit("related").alias("kind"))


def issues(answers: DataFrame, kind: str = "Issue") -> DataFrame:
    """answers with parts meta, comments, reviews -> (id, title, byline, lost, markdown) of issues, or of pull requests as kind Pull."""
    a = answers_of(answers, ["meta", "comments", "reviews"])
    comments, no_comments = listed("comments", REMARKS)
    reviews, no_reviews = listed("reviews", REMARKS)
    rows = a.where("meta is not null").select("id", F.from_json("meta", ISSUE).alias("d"), comments.alias("comments"), no_comments.alias("no_comments"), reviews.alias("reviews"), no_reviews.alias("no_reviews"))
    title = F.concat(F.lit(f"{kind} #"), F.col("d.number").cast("string"), F.lit(": "), F.coalesce(filled(F.col("d.title")), F.lit("(untitled)")))
    said = F.array_join(F.transform(F.filter("comments", lambda c: F.coalesce(c["body"], F.lit("")) != ""), lambda c: F.concat(F.lit("**"), F.coalesce(c["user"]["login"], F.lit("")), F.lit(":**\n\n"), c["body"], F.lit("\n\n"))), "")
    main = closed([F.concat(F.lit("# "), title, F.lit("\n")), F.concat(F.lit("**State:** "), F.coalesce(filled(F.col("d.state")), F.lit("open"))), F.concat(F.lit(" | **Author:** "), filled(F.col("d.user.login"))), F.lit("\n\n"), F.concat(filled(F.col("d.body")), F.lit("\n\n")), F.lit("---\n\n## Comments\n\n"), F.when(F.col("no_comments"), F.lit(MISSING + "\n\n")), said])
    judged = F.array_join(F.transform("reviews", lambda r: F.concat(F.lit("**"), F.coalesce(r["user"]["login"], F.lit("")), F.lit("** ("), F.coalesce(r["state"], F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(":\n\n"), filled(r["body"])), F.lit("")), F.lit("\n\n"))), "")
    more = F.when(F.col("no_reviews"), F.lit("\n## Reviews\n\n" + MISSING + "\n")).when(F.size("reviews") > 0, F.concat(F.lit("\n## Reviews\n\n"), judged))
    lost = F.array_compact(F.array(F.when(F.col("no_reviews"), "reviews"), F.when(F.col("no_comments"), "comments")))
    return rows.select("id", title.alias("title"), filled(F.col("d.user.login")).alias("byline"), lost.alias("lost"), F.when(more.isNull(), main).otherwise(closed([main, more])).alias("markdown"))


def papers(answers: DataFrame) -> DataFrame:
    """answers (id, payload), Atom feeds of papers -> (id, pos, title, byline, categories, markdown, total); total is what the feed says there is."""
    feed = answers.select("id", F.from_xml("payload", FEED).alias("f"))
    each = feed.select("id", F.col("f.`opensearch:totalResults`").try_cast("long").alias("total"), F.posexplode("f.entry").alias("pos", "e"))
    line = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    authors = F.array_join(F.filter(F.transform("e.author", lambda a: line(a["name"])), lambda n: n != ""), ", ")
    categories = F.coalesce(F.filter(F.transform("e.category", lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.array().cast("array<string>"))
    rows = each.select("id", "pos", filled(line(F.col("e.title"))).alias("title"), filled(authors).alias("byline"), filled(line(F.col("e.summary"))).alias("summary"), categories.alias("categories"), "total")
    listed_ = F.when(F.size("categories") > 0, F.concat(F.lit("\n## Categories\n\n"), F.array_join(F.transform("categories", lambda c: F.concat(F.lit("- "), c)), "\n")))
    text = F.array_join(F.array_compact(F.array(F.concat(F.lit("# "), "title", F.lit("\n")), F.concat(F.lit("_"), "byline", F.lit("_\n")), F.concat("summary", F.lit("\n")), listed_)), "\n")
    return rows.select("id", "pos", "title", "byline", "categories", closed([text]).alias("markdown"), "total")


def paper_listings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, subject, span, html) of listings -> (page_id, verdict, shown, total, markdown), and links (page_id, place, anchor, url, reason, kind).

    A paper is a dt with the dd right after it. A page without the list, or with papers of which none has an address and a
    title, has rotted; a list without any is empty.
    """
    n = stored(M.nodes(pages))
    a = F.col("attrs")
    boxes = n.where((F.col("tag") == "dl") & (a["id"] == "articles")).select("page_id", F.col("pos").alias("parent"))
    w = Window.partitionBy("page_id", "parent").orderBy("pos")
    pairs = n.where(F.col("tag").isin("dt", "dd")).join(boxes, ["page_id", "parent"]).select("page_id", "pos", "tag", F.lead("tag").over(w).alias("next"), F.lead("pos").over(w).alias("dd")).where("tag = 'dt'")
    dts, dds = pairs.select("page_id", "pos"), pairs.where("next = 'dd'").select("page_id", F.col("dd").alias("pos"))
    href = M.first_inside(n.where((F.col("tag") == "a") & (a["title"] == "Abstract")).withColumn("href", a["href"]), dts, "href")
    found = pairs.where("next = 'dd'").select("page_id", "pos", "dd").join(href, ["page_id", "pos"], "left")
    for name, css, label in (("title", "list-title", "Title:"), ("authors", "list-authors", "Authors:")):
        spot = M.first_inside(n.where(F.col("tag") == "div").where(M.having(a, css)).withColumn("spot", F.col("pos")), dds, "spot")
        texts = M.subtree_texts(n, spot.select("page_id", F.col("spot").alias("pos"))).withColumnRenamed("pos", "spot")
        said = spot.join(texts, ["page_id", "spot"]).select("page_id", F.col("pos").alias("dd"), F.trim(F.regexp_replace("text", f"^{label}", "")).alias(name))
        found = found.join(said, ["page_id", "dd"], "left")
    good = found.where("coalesce(href, '') <> '' and coalesce(title, '') <> ''").select("page_id", "pos", F.concat(F.lit("https://arxiv.org/abs/"), F.substring_index("href", "/", -1)).alias("url"), "title", F.coalesce("authors", F.lit("")).alias("authors"))
    placed = stored(good.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1))
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), "authors", F.lit(")\n  <"), "url", F.lit(">"))
    shown = placed.where(F.col("place") < PAPERS).groupBy("page_id").agg(F.count(F.lit(1)).alias("shown"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    base = pages.select("page_id", "subject", "span", listing_total(F.col("html")).alias("total"))
    out = base.join(boxes.groupBy("page_id").agg(F.lit(True).alias("boxed")), "page_id", "left").join(pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("came")), "page_id", "left").join(shown, "page_id", "left")
    verdict = F.when(F.col("boxed").isNull() | (F.col("came").isNotNull() & F.col("shown").isNull()), "ROT").when(F.col("came").isNull(), "EMPTY").otherwise("OK")
    count = F.coalesce("shown", F.lit(0))
    more = F.col("total") > count
    told = lambda c: c.cast("string")
    head = F.concat(F.lit("# arXiv · "), "subject", F.lit(" · "), "span", F.lit("\n\n## Papers ("), told(count), F.when(more, F.concat(F.lit(" of "), told(F.col("total")))).otherwise(""), F.lit(")\n\n"), F.when(more, F.concat(F.lit("_Showing "), told(count), F.lit(" of "), told(F.col("total")), F.lit(" entries the page advertises — this is a partial view._\n\n"))).otherwise(""))
    links = placed.where(F.col("place") < NEXT).select("page_id", "place", F.col("title").alias("anchor"), "url", F.coalesce(filled(F.col("authors")), F.lit("abstract")).alias("reason"), F.lit("drilldown").alias("kind"))
    return out.select("page_id", verdict.alias("verdict"), count.cast("long").alias("shown"), "total", F.when(verdict == "ROT", F.lit(None)).otherwise(closed([head, F.col("lines")])).alias("markdown")), links
