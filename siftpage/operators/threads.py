"""Threads of comments and forum topics: answers of their sites as tables, and tables as texts set in by depth."""

from __future__ import annotations

import json
import re
from html import unescape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.fragments import fragment_markdown, fragment_text
from siftpage.functions.texts import partial_note, quoted
from siftpage.operators.trees import ordered, saved, shown

COMMENTS, DEEPEST = 400, 20  # fixed values: comments of a thread that are shown, and levels of them
NO_ANSWER = "no answer"
TOPIC = "title string, fancy_title string, post_stream struct<posts:array<struct<post_number:int,reply_to_post_number:int,username:string,cooked:string>>>"

_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"[ \t\n\r]*")
_JSON = json.JSONDecoder(parse_int=float)  # int() refuses numbers of some thousand digits


def parsed(text: str):
    """The value of a JSON text of any depth of nesting, whole numbers as floats; a ValueError says what is wrong with others."""
    try:
        return _JSON.decode(text)
    except RecursionError:
        return unnested(text)


def unnested(text: str):
    """parsed() with a list for a stack, for what is nested deeper than the interpreter's own stack bears."""
    char = lambda: text[at : at + 1]
    past = lambda i: _SPACE.match(text, i).end()

    def scalar():
        try:
            return _JSON.scan_once(text, at)
        except StopIteration:
            raise json.JSONDecodeError("Expecting value", text, at) from None

    def passed(want: str) -> int:
        if char() != want:
            raise json.JSONDecodeError(f"Expecting {want}", text, at)
        return past(at + 1)

    whole, above, key, at = [], [], None, past(0)
    into = whole
    while True:
        if isinstance(into, dict):
            if char() != '"':
                raise json.JSONDecodeError("Expecting a name", text, at)
            key, at = scalar()
            at = past(at)
            at = passed(":")
        opens = char() in ("{", "[")
        value, at = ({} if char() == "{" else [], at + 1) if opens else scalar()
        at = past(at)
        if isinstance(into, dict):
            into[key] = value
        else:
            into.append(value)
        if opens:
            above.append(into)
            into = value
            if char() != ("}" if isinstance(into, dict) else "]"):
                continue
        while above and char() == ("}" if isinstance(into, dict) else "]"):
            into, at = above.pop(), past(at + 1)
        if not above:
            if at < len(text):
                raise json.JSONDecodeError("Extra data", text, at)
            return whole[0]
        at = passed(",")


class Comments:
    """UDTF: a row for the item of a nested answer, at place -1, then one per comment, depth first. parent is the place of the
    comment it answers; depth does not count removed comments above. What is no object is left out with all below it; of an
    answer that is no JSON object the row at place -1 says so in failure, which is null for all others. Spark's own JSON
    functions stop at a thousand levels of nesting."""

    def eval(self, payload: str):
        item, failure = None, None
        try:
            item = None if payload is None else parsed(payload)
        except ValueError as e:
            failure = f"no JSON: {e}"
        if not isinstance(item, dict):
            yield -1, None, 0, False, None, None, None, None, NO_ANSWER if payload is None else failure or "no object"
            return
        text = lambda x: x if isinstance(x, str) else None
        yield -1, None, 0, False, *(text(item.get(k)) for k in ("author", "text", "title", "url")), None
        todo = [(c, None, 1) for c in reversed(children(item))]
        pos = 0
        while todo:
            node, parent, depth = todo.pop()
            removed = not unescape(_TAG.sub("", text(node.get("text")) or "")).strip()
            yield pos, parent, depth, removed, text(node.get("author")), text(node.get("text")), None, None, None
            todo += [(c, pos, depth + (not removed)) for c in reversed(children(node))]
            pos += 1


def children(node) -> list[dict]:
    own = node.get("children") if isinstance(node, dict) else None
    return [c for c in own if isinstance(c, dict)] if isinstance(own, list) else []


COMMENT_ROWS = "pos int, parent int, depth int, removed boolean, author string, text string, title string, url string, failure string"


def comments(answers: DataFrame) -> DataFrame:
    """answers (tree, payload) -> tree and COMMENT_ROWS: the item and every comment of a nested answer."""
    each = F.udtf(Comments, returnType=COMMENT_ROWS)
    return answers.select("tree", "payload").lateralJoin(each(F.col("payload").outer())).drop("payload")


def drawn(found: DataFrame, most: int = COMMENTS, deepest: int = DEEPEST) -> DataFrame:
    """comments() with place (how many were drawn before it, from 1) and cut: one budget for a whole thread is spent depth
    first, on removed comments too; what is too deep costs nothing, and neither it nor what comes after the budget is drawn."""
    fits = F.col("depth") <= deepest
    place = F.count_if(fits).over(Window.partitionBy("tree").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("place", place.cast("int")).withColumn("cut", ~fits | (F.col("place") > most))


def threads(answers: DataFrame, most: int = COMMENTS, deepest: int = DEEPEST) -> DataFrame:
    """answers (tree, payload) -> (tree, title, author, url, shown, removed, truncated, markdown, failure) of nested answers.

    An answer that did not come or is no JSON object has null for all but failure, which says why. Comments stand behind as many marks as they are deep, a removed one
    leaves its replies where it stood; a thread that is not whole says so.
    """
    every = saved(comments(answers))  # read twice, parsed once
    rows = drawn(every.where("pos >= 0"), most, deepest)
    top = F.max(F.when(F.col("parent").isNull(), F.col("pos"))).over(Window.partitionBy("tree").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    block = F.concat(quoted(fragment_markdown(F.col("text")), F.col("depth")), F.lit("\n"), F.repeat(F.lit(">"), F.col("depth")), F.lit("\n"), signed("", F.coalesce("author", F.lit("[deleted]"))))
    visible = ~F.col("cut") & ~F.col("removed")
    kept = rows.withColumn("top", top).groupBy("tree", "top").agg(F.count_if(visible).alias("shown"), F.count_if(~F.col("cut") & F.col("removed")).alias("removed"), F.bool_or("cut").alias("truncated"), _joined(F.when(visible, F.struct("pos", block.alias("block")))).alias("text"))
    g = kept.groupBy("tree").agg(F.sum("shown").alias("shown"), F.sum("removed").alias("removed"), F.bool_or("truncated").alias("truncated"), F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("top", "text")))), lambda x: x["text"]).alias("texts"))
    item = every.where("pos < 0").select("tree", F.when(F.col("failure").isNull(), F.struct("title", "author", "url", "text")).alias("i"), "failure")
    out = item.join(g.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of")), "left")
    title, author, url, body = F.nullif(F.trim("i.title"), F.lit("")), F.nullif(F.col("i.author"), F.lit("")), F.nullif(F.col("i.url"), F.lit("")), F.nullif(fragment_markdown(F.coalesce("i.text", F.lit(""))), F.lit(""))
    truncated = F.coalesce("truncated", F.lit(False))
    note = F.when(truncated, F.lit(f"\n_Thread truncated: rendering stops at {most} comments or {deepest} levels of nesting._\n"))
    head = F.array(F.concat(F.lit("# "), title, F.lit("\n")), F.concat(F.lit("by "), author, F.lit("\n")), F.concat(F.lit("<"), url, F.lit(">\n")), F.concat(body, F.lit("\n")), F.lit("---\n"), F.lit("## Comments\n"))
    parts = F.array_compact(F.concat(head, F.coalesce("texts", F.array().cast("array<string>")), F.array(note)))
    counted = lambda c: F.when(F.col("i").isNotNull(), F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return out.select("tree", title.alias("title"), author.alias("author"), url.alias("url"), counted("shown"), counted("removed"), F.when(F.col("i").isNotNull(), truncated).alias("truncated"), F.when(F.col("i").isNotNull(), _closed(parts)).alias("markdown"), "failure")


def signed(before: str | Column, author: Column) -> Column:
    lead = F.lit(before) if isinstance(before, str) else before
    return F.concat(lead, F.repeat(F.lit(">"), F.col("depth")), F.lit(" — "), author, F.lit("\n"))


def _joined(item: Column) -> Column:
    """Blocks one after the other, by their place."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["block"]), "")


def _closed(parts: Column) -> Column:
    return F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def topics(answers: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """answers (tree, payload) -> (tree, title, author, posts, shown, markdown) of forum topics, whose posts name the post they answer.

    The post of the smallest number opens the topic. Answers to a post that is not there, or to the post itself, hang under
    the opening one; what is deeper than `deepest` is not shown; a removed post leaves a line. Answers without a list of posts
    give no row, and rows of one number are one post, the first in the answer.
    """
    a = answers.select("tree", F.from_json("payload", TOPIC).alias("a"))
    posts = a.select("tree", F.posexplode("a.post_stream.posts").alias("at", "p")).where("p.post_number is not null")
    posts = posts.groupBy("tree", F.col("p.post_number").alias("id")).agg(F.min_by("p", "at").alias("p")).select("tree", "id", F.col("p.reply_to_post_number").alias("parent"), F.nullif(F.col("p.username"), F.lit("")).alias("author"), fragment_markdown(F.coalesce("p.cooked", F.lit(""))).alias("body"))
    posts = saved(posts)  # read four times, parsed once
    opening = posts.groupBy("tree").agg(F.min_by(F.struct("id", "author", "body"), "id").alias("op"), F.count(F.lit(1)).alias("posts"))
    replies = posts.join(opening.select("tree", F.col("op.id").alias("first")), "tree").where("id <> first")
    nodes = replies.select("tree", "id", F.when(F.col("parent") != F.col("first"), F.col("parent")).alias("parent"), F.col("id").alias("pos"), F.lit(1).alias("level"))
    found = shown(ordered(nodes, deepest, adopt=True), 2**31 - 1, deepest)
    author = F.coalesce("author", F.lit("[unknown]"))
    mark = F.repeat(F.lit(">"), F.col("depth"))
    block = F.when(F.col("body") != "", signed(F.concat(quoted(F.col("body"), F.col("depth")), F.lit("\n"), mark, F.lit("\n")), author)).otherwise(F.concat(mark, F.lit(" _[post removed]_ — "), author, F.lit("\n")))
    blocks = found.join(posts, ["tree", "id"]).groupBy("tree", "top").agg(F.count(F.lit(1)).alias("shown"), _joined(F.struct("place", block.alias("block"))).alias("text"))
    g = blocks.groupBy("tree").agg(F.sum("shown").alias("shown"), F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]).alias("texts"))
    title = F.nullif(fragment_text(F.coalesce(F.nullif(F.col("a.fancy_title"), F.lit("")), F.col("a.title"), F.lit(""))), F.lit(""))
    out = a.join(opening, "tree").join(g, "tree", "left").select("tree", title.alias("title"), F.col("op.author").alias("author"), F.nullif(F.col("op.body"), F.lit("")).alias("body"), "posts", F.coalesce("shown", F.lit(0)).alias("shown"), "texts")
    head = F.array(F.concat(F.lit("# "), "title", F.lit("\n")), F.concat(F.lit("by "), "author", F.lit("\n")), F.concat("body", F.lit("\n")), F.lit("---\n"), F.lit("## Discussion\n"))
    return out.select("tree", "title", "author", "posts", "shown", _closed(F.array_compact(F.concat(head, F.coalesce("texts", F.array().cast("array<string>"))))).alias("markdown"))


ARTICLE = "titleHtml string, textHtml string, author struct<alias:string>"
MAPPED = "comments map<string,struct<parentId:string,message:string,author:struct<alias:string>>>, threads array<string>"
MISSING = "_(this section was NOT retrieved — treat as unknown, not as empty)_"  # a fixed value


def mapped_comments(answers: DataFrame) -> DataFrame:
    """answers (tree, comments) with comments in a map by id and the roots in a list -> (tree, id, parent, pos, author, body).

    The children of a comment come in the order of the map, roots in that of their list, an id listed twice once. A comment
    that is neither listed nor under another one hangs on a parent that is not there.
    """
    a = answers.select("tree", F.from_json("comments", MAPPED).alias("c"))
    each = a.select("tree", F.posexplode(F.map_entries("c.comments")).alias("at", "e"), F.col("c.threads").alias("threads")).where("e.value is not null")
    place = F.array_position("threads", F.col("e.key"))
    root = F.coalesce(place > 0, F.lit(False))
    parent = F.when(~root, F.coalesce("e.value.parentId", F.lit("")))
    return each.select("tree", F.col("e.key").alias("id"), parent.alias("parent"), F.when(root, place).otherwise(F.col("at")).cast("long").alias("pos"), F.coalesce(F.nullif(F.col("e.value.author.alias"), F.lit("")), F.lit("[unknown]")).alias("author"), fragment_markdown(F.coalesce("e.value.message", F.lit(""))).alias("body"))


def discussed_articles(answers: DataFrame, most: int = COMMENTS, deepest: int = DEEPEST) -> DataFrame:
    """answers (tree, article, comments) -> (tree, title, byline, came, shown, rotten, markdown).

    Comments that are null did not come, and the text says so; an answer of another shape has rotted; one without comments adds
    nothing. What the budget or the depth leaves out is counted in a note. A removed comment leaves a line.
    """
    found = saved(mapped_comments(answers))  # read three times, parsed once
    drawn_ = shown(ordered(found.select("tree", "id", "parent", "pos", F.lit(1).alias("level")), deepest), most, deepest)
    mark = F.repeat(F.lit(">"), F.col("depth"))
    block = F.when(F.col("body") != "", signed(F.concat(quoted(F.col("body"), F.col("depth")), F.lit("\n"), mark, F.lit("\n")), F.col("author"))).otherwise(F.concat(mark, F.lit(" _[comment removed]_ — "), "author", F.lit("\n")))
    blocks = drawn_.join(found, ["tree", "id"]).groupBy("tree", "top").agg(F.count(F.lit(1)).alias("shown"), F.min("place").alias("first"), _joined(F.struct("place", block.alias("block"))).alias("text"))
    g = blocks.groupBy("tree").agg(F.sum("shown").alias("shown"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n").alias("body"))
    came = found.groupBy("tree").agg(F.count(F.lit(1)).alias("came"))
    art, com = F.from_json("article", ARTICLE), F.from_json("comments", "comments string, threads string")
    rows = answers.select("tree", art.alias("a"), F.col("comments").isNull().alias("lost"), com.alias("c")).join(g, "tree", "left").join(came, "tree", "left")
    shaped = F.coalesce(F.col("c.comments").startswith("{") & F.col("c.threads").startswith("["), F.lit(False))
    title, byline, text = F.nullif(fragment_text(F.coalesce("a.titleHtml", F.lit(""))), F.lit("")), F.nullif(F.col("a.author.alias"), F.lit("")), F.nullif(fragment_markdown(F.coalesce("a.textHtml", F.lit(""))), F.lit(""))
    note = partial_note(F.coalesce("shown", F.lit(0)), F.coalesce("came", F.lit(0)), F.lit("comments"))
    discussion = F.when(F.col("lost"), F.lit(f"---\n\n## Discussion\n\n{MISSING}\n")).when(F.coalesce("came", F.lit(0)) > 0, F.concat(F.lit("---\n\n## Discussion\n\n"), F.when(note != "", F.concat(note, F.lit("\n"))).otherwise(""), F.coalesce("body", F.lit(""))))
    parts = F.array_compact(F.array(F.concat(F.lit("# "), title, F.lit("\n")), F.concat(F.lit("by "), byline, F.lit("\n")), F.concat(text, F.lit("\n")), discussion))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("tree", title.alias("title"), byline.alias("byline"), zero("came"), zero("shown"), (~F.col("lost") & ~shaped).alias("rotten"), _closed(parts).alias("markdown"))
