"""Pages as tables of nodes, and what is read off them: text, metadata, repeated records, sections behind controls, declared fields.

Only the splitting of markup into nodes is Python; everything else is joins, windows and aggregates over the nodes.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.functions.fragments import fragment_markdown
from siftpage.operators.trees import stored

# Elements without content, those that the next of their kind ends, blocks of text, and what is not the text of a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "p": {"p", "ul", "ol", "dl", "div", "table", "blockquote", "pre", "section", "article", "header", "footer", "nav", "aside", "form", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = [*HEADINGS, "p", "li", "pre", "blockquote", "td", "dd"]
CHROME = ["nav", "aside", "footer", "script", "style", "noscript", "template", "form", "head"]
CONSISTENT, HEADED, LEAST_RECORDS, GATES = 0.7, 0.5, 3, 50

NODES = "page_id long, pos int, parent int, last int, tag string, attrs map<string,string>, text string, ancestors array<int>, tags array<string>, before int, upto int, start int, stop int"
PARSED = 500  # pages of markup that a worker hands over at a time


class _Nodes(HTMLParser):
    """Rows of one page: elements in order of opening, and texts between tags under the tag #text. Of each the texts before it
    and up to its end are counted, and its place in the markup is kept."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[int, str]] = []
        self.texts, self.length = 0, len(html)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        self._end(0, self.length)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _add(self, tag: str, attrs: dict, text: str | None) -> None:
        at = len(self.rows)
        self.rows.append([at, self.open[-1][0] if self.open else None, at, tag, attrs, text, [p for p, _ in self.open], [t for _, t in self.open], self.texts, self.texts, self._at(), self.length])
        self.texts += text is not None
        self.rows[-1][9] = self.texts

    def _end(self, depth: int, stop: int) -> None:
        while len(self.open) > depth:
            row = self.rows[self.open.pop()[0]]
            row[2], row[9], row[11] = len(self.rows) - 1, self.texts, stop

    def handle_starttag(self, tag, attrs):
        if self.open and tag in ENDED_BY.get(self.open[-1][1], ()):
            self._end(len(self.open) - 1, self._at())
        self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append((len(self.rows) - 1, tag))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][1] == tag:
                return self._end(depth, self._at())

    def handle_data(self, data):
        if data.strip():
            self._add("#text", {}, data)


def nodes(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> NODES: each node with its place, its last descendant's place, its ancestors' places and tags, the
    number of texts before it and up to its end, and where its markup starts and stops."""
    ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), ints, texts, *[pa.int32()] * 4]
    names = [c.split()[0] for c in NODES.split(", ")]

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARSED):
                part = batch.slice(at, PARSED)
                rows = [[i, *r] for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in _Nodes(h or "").rows]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                columns[5] = [list(a.items()) for a in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(split, NODES)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _classes(attrs: Column) -> Column:
    return F.split(squeezed(F.coalesce(attrs["class"], F.lit(""))), " ")


def subtree_texts(n: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (page_id, pos) -> (page_id, pos, text): the text of each and all below it, one run of the page's texts in order."""
    texts = n.where("tag = '#text'").groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]).alias("ts"))
    wanted = n.select("page_id", "pos", "before", "upto").where("upto > before").join(roots.select("page_id", "pos").distinct(), ["page_id", "pos"])
    own = F.slice("ts", F.col("before") + 1, F.col("upto") - F.col("before"))
    return wanted.join(texts, "page_id").select("page_id", "pos", squeezed(F.array_join(own, " ")).alias("text"))


def having(attrs: Column, *names: str) -> Column:
    """Whether an element has all of the classes."""
    own = _classes(attrs)
    return reduce(lambda a, b: a & b, (F.array_contains(own, c) for c in names))


def inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner with a row for each element of outer (page_id, pos) that holds it, at `box`: of the ancestors those that are among
    the page's outer places, so only they become rows."""
    boxes = outer.groupBy("page_id").agg(F.collect_set("pos").alias("boxes"))
    return inner.join(boxes, "page_id").select(*inner.columns, F.explode(F.array_intersect("ancestors", "boxes")).alias("box"))


def nested(n: DataFrame, outer: DataFrame) -> DataFrame:
    """n with `holder`, the nearest element of outer around a node, and `holders`, how many there are."""
    boxes = outer.groupBy("page_id").agg(F.collect_set("pos").alias("boxes"))
    around = F.array_intersect("ancestors", "boxes")
    out = n.join(boxes, "page_id").select(*n.columns, around.alias("around"))
    return out.select(*n.columns, F.get("around", F.size("around") - 1).alias("holder"), F.size("around").alias("holders"))


def first_inside(inner: DataFrame, outer: DataFrame, *columns: str) -> DataFrame:
    """(page_id, pos, ..): for each element of outer the columns of the first of inner in it."""
    g = inside(inner, outer).groupBy("page_id", F.col("box").alias("pos")).agg(F.min_by(F.struct(*columns), "pos").alias("f"))
    return g.select("page_id", "pos", "f.*")


def articles(n: DataFrame) -> DataFrame:
    """(page_id, title, markdown, headings): the text of a page in its blocks, outside of what is chrome, links kept."""
    inside = ~F.exists("tags", lambda t: t.isin(CHROME))
    zipped = F.arrays_zip(F.col("ancestors").alias("p"), F.col("tags").alias("t"))
    block = F.element_at(F.filter(zipped, lambda z: z["t"].isin(BLOCKS)), F.lit(-1))
    link = F.element_at(F.filter(zipped, lambda z: z["t"] == "a"), F.lit(-1))["p"]
    texts = n.where((F.col("tag") == "#text") & inside & F.exists("tags", lambda t: t.isin(BLOCKS))).select("page_id", "pos", squeezed(F.col("text")).alias("text"), block.alias("b"), F.when(F.exists("tags", lambda t: t == "a"), link).alias("link"))
    hrefs = n.where("tag = 'a'").select("page_id", F.col("pos").alias("link"), F.col("attrs")["href"].alias("href"))
    texts = texts.join(hrefs, ["page_id", "link"], "left").withColumn("piece", F.when(F.col("href").isNotNull(), F.concat(F.lit("["), "text", F.lit("]("), "href", F.lit(")"))).otherwise(F.col("text")))
    lines = texts.groupBy("page_id", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("line"))
    level = F.substring("b.t", 2, 1).cast("int")
    heading = F.col("b.t").isin(HEADINGS)
    marked = F.when(heading, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "line")).when(F.col("b.t") == "li", F.concat(F.lit("- "), "line")).when(F.col("b.t") == "blockquote", F.concat(F.lit("> "), "line")).otherwise(F.col("line"))
    item = F.struct(F.col("b.p").alias("p"), marked.alias("m"), F.when(heading, F.struct(level.alias("level"), F.col("line").alias("text"))).alias("h"))
    g = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    titles = n.where((F.col("tag") == "#text") & F.array_contains("tags", "title")).groupBy("page_id").agg(F.min_by("text", "pos").alias("title"))
    pages = n.select("page_id").distinct().join(g, "page_id", "left").join(titles, "page_id", "left")
    heads = F.array_compact(F.transform("xs", lambda x: x["h"]))
    return pages.select("page_id", squeezed(F.coalesce("title", F.filter(heads, lambda h: h["level"] == 1)[0]["text"])).alias("title"), F.coalesce(F.array_join(F.transform("xs", lambda x: x["m"]), "\n\n"), F.lit("")).alias("markdown"), F.transform(heads, lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"])).alias("headings"))


def metadata(n: DataFrame) -> DataFrame:
    """(page_id, key, value): og.*, twitter.*, author and description of meta elements, the first of each."""
    name = F.lower(F.coalesce(F.col("attrs")["property"], F.col("attrs")["name"]))
    m = n.where("tag = 'meta'").select("page_id", "pos", F.regexp_replace(name, ":", ".").alias("key"), F.col("attrs")["content"].alias("value"))
    return m.where(F.col("key").rlike(r"^(og|twitter|article)\.|^(author|description)$") & F.col("value").isNotNull()).groupBy("page_id", "key").agg(F.min_by("value", "pos").alias("value"))


def published(n: DataFrame) -> DataFrame:
    """(page_id, published): of what a page says of its date the first that is one; a first of January is none."""
    a = F.col("attrs")
    said = F.when(F.lower(a["property"]) == "article:published_time", F.struct(F.lit(0).alias("rank"), a["content"].alias("v"))).when(F.lower(a["itemprop"]) == "datepublished", F.struct(F.lit(1).alias("rank"), F.coalesce(a["content"], a["datetime"]).alias("v"))).when(F.col("tag") == "time", F.struct(F.lit(2).alias("rank"), a["datetime"].alias("v")))
    day = F.left(F.col("s.v"), F.lit(10)).try_cast("date")
    found = n.select("page_id", "pos", said.alias("s")).where("s is not null").withColumn("day", day).where("day is not null and not (month(day) = 1 and dayofmonth(day) = 1)")
    return found.groupBy("page_id").agg(F.min_by("day", F.struct("s.rank", "pos")).alias("published"))


def records(n: DataFrame) -> DataFrame:
    """(page_id, signature, pos, depth, heading, href, text): the page's dominant repeated records.

    A signature is a tag and its first class. It counts if it has LEAST_RECORDS nodes or more, most of them in parents of one
    signature, half of them with a heading or a link that stands for one. The one with most records times text wins; of two
    that are near the outer.
    """
    sig = F.concat("tag", F.lit("."), F.get(_classes(F.col("attrs")), F.lit(0)))
    els = n.where((F.col("tag") != "#text") & (F.get(_classes(F.col("attrs")), F.lit(0)) != "") & ~F.exists("tags", lambda t: t.isin(CHROME))).select("page_id", "pos", "parent", "last", sig.alias("signature"), F.size("ancestors").alias("depth"))
    up = n.where("tag <> '#text'").select("page_id", F.col("pos").alias("parent"), F.concat("tag", F.lit("."), F.coalesce(F.get(_classes(F.col("attrs")), F.lit(0)), F.lit(""))).alias("parent_signature"))
    inner = n.where(F.col("tag").isin(*HEADINGS, "a")).select("page_id", F.col("pos").alias("h"), F.col("tag").alias("h_tag"), F.col("attrs")["href"].alias("href"), F.explode("ancestors").alias("pos"))
    first = inner.groupBy("page_id", "pos").agg(F.min_by("h", F.struct(~F.col("h_tag").isin(HEADINGS), "h")).alias("h"), F.min_by("href", F.struct(F.col("href").isNull(), "h")).alias("href"))
    with_text = els.join(subtree_texts(n, els), ["page_id", "pos"], "left").join(first, ["page_id", "pos"], "left").join(up, ["page_id", "parent"], "left")
    by_parent = with_text.groupBy("page_id", "signature", "parent_signature").agg(F.count(F.lit(1)).alias("k"), F.count("h").alias("headed"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("volume"), F.min("depth").alias("depth"))
    stats = by_parent.groupBy("page_id", "signature").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.sum("headed").alias("headed"), F.sum("volume").alias("volume"), F.min("depth").alias("depth"))
    good = stats.where((F.col("n") >= LEAST_RECORDS) & (F.col("most") >= CONSISTENT * F.col("n")) & (F.col("headed") >= HEADED * F.col("n"))).withColumn("weight", F.col("n") * F.col("volume"))
    top = Window.partitionBy("page_id")
    best = good.withColumn("top", F.max("weight").over(top)).where("weight >= 0.9 * top").withColumn("nth", F.row_number().over(top.orderBy("depth", F.desc("weight"), "signature"))).where("nth = 1").select("page_id", "signature")
    heads = subtree_texts(n, first.select("page_id", F.col("h").alias("pos"))).select("page_id", F.col("pos").alias("h"), F.col("text").alias("heading"))
    out = with_text.join(best, ["page_id", "signature"]).join(heads, ["page_id", "h"], "left")
    return out.select("page_id", "signature", "pos", "depth", "heading", "href", F.coalesce("text", F.lit("")).alias("text"))


def record_texts(found: DataFrame) -> DataFrame:
    """(page_id, text): records as a list, each led by its linked heading and set in by how deep it is below the others."""
    base = Window.partitionBy("page_id")
    step = F.col("depth") - F.min("depth").over(base)
    head = F.when(F.col("heading").isNotNull() & F.col("href").isNotNull(), F.concat(F.lit("["), "heading", F.lit("]("), "href", F.lit(")"))).otherwise(F.col("heading"))
    rest = F.when(F.col("heading").isNotNull(), squeezed(F.replace(F.col("text"), F.col("heading"), F.lit("")))).otherwise(F.col("text"))
    line = F.concat(F.repeat(F.lit("  "), step), F.lit("- "), F.concat_ws(" ", head, F.nullif(rest, F.lit(""))))
    lines = found.select("page_id", "pos", line.alias("line"))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def gated_sections(n: DataFrame, cap: int = GATES) -> DataFrame:
    """(page_id, handle, label, stated_count): tabs whose panel is missing or empty, and closed details without a body.

    Navigation is left out, a label is told apart from the count in it, each label counts once, and handles go in page order.
    """
    a = F.col("attrs")
    outside = n.where(~F.array_contains("tags", "nav") & (F.col("tag") != "#text"))
    panels = n.where(F.col("attrs")["id"].isNotNull()).select("page_id", F.col("attrs")["id"].alias("panel"), "pos")
    filled = subtree_texts(n, panels).where("text <> ''").join(panels, ["page_id", "pos"]).select("page_id", "panel").distinct()
    tabs = outside.where(a["role"] == "tab").select("page_id", "pos", a["aria-controls"].alias("panel"), a["aria-selected"].alias("chosen"))
    shut = tabs.where("coalesce(chosen, '') <> 'true'").join(filled, ["page_id", "panel"], "left_anti").select("page_id", "pos")
    details = outside.where((F.col("tag") == "details") & ~F.map_contains_key("attrs", F.lit("open"))).select("page_id", F.col("pos").alias("d"))
    within = n.where(F.array_contains("tags", "details") & (F.col("tag") == "#text")).select("page_id", F.explode("ancestors").alias("d"), F.array_contains("tags", "summary").alias("summary"))
    bodies = within.where("not summary").join(details, ["page_id", "d"]).select("page_id", "d").distinct()
    empty = details.join(bodies, ["page_id", "d"], "left_anti").join(n.where("tag = 'summary'").select("page_id", "pos", F.col("parent").alias("d")), ["page_id", "d"]).select("page_id", "pos")
    marked = subtree_texts(n, shut.union(empty)).where("text <> ''")
    part = lambda k: F.nullif(F.regexp_extract("text", r"^(.*\S)\s+\(?([0-9]+)\)?$", k), F.lit(""))
    one = marked.select("page_id", "pos", F.coalesce(part(1), F.col("text")).alias("label"), part(2).cast("int").alias("stated_count")).groupBy("page_id", "label").agg(F.min_by(F.struct("pos", "stated_count"), "pos").alias("f"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos"))
    return one.select("page_id", nth.alias("handle"), "label", "f.stated_count").where(F.col("handle") <= cap)


def declared_rows(n: DataFrame, container: str, row: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, verdict, pos, fields): rows by a schema of `tag.class` names. A page without the container, or with rows of which
    none has a field, has rotted; one with a container and no rows is empty."""
    is_ = lambda spec: (F.col("tag") == spec.split(".")[0]) & (F.array_contains(_classes(F.col("attrs")), spec.split(".")[1]) if "." in spec else F.lit(True))
    boxes = n.where(is_(container)).select("page_id", F.col("pos").alias("box"))
    rows = n.where(is_(row)).select("page_id", "pos", F.explode("ancestors").alias("box")).join(boxes, ["page_id", "box"]).select("page_id", "pos").distinct()
    named = None
    for k, spec in fields.items():
        hit = n.where(is_(spec)).select("page_id", F.lit(k).alias("field"), F.col("pos").alias("f"), F.explode("ancestors").alias("pos")).join(rows, ["page_id", "pos"])
        named = hit if named is None else named.union(hit)
    first = named.groupBy("page_id", "pos", "field").agg(F.min("f").alias("f"))
    values = first.join(subtree_texts(n, first.select("page_id", F.col("f").alias("pos"))).withColumnRenamed("pos", "f"), ["page_id", "f"], "left")
    by_row = values.groupBy("page_id", "pos").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.coalesce("text", F.lit("")))))).alias("fields"))
    per_page = n.select("page_id").distinct().join(boxes.groupBy("page_id").agg(F.lit(True).alias("boxed")), "page_id", "left").join(rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows")), "page_id", "left").join(by_row.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_read")), "page_id", "left")
    verdict = F.when(F.col("boxed").isNull() | (F.col("n_rows").isNotNull() & F.col("n_read").isNull()), "ROT").when(F.col("n_rows").isNull(), "EMPTY").otherwise("OK")
    return per_page.select("page_id", verdict.alias("verdict")).join(by_row, "page_id", "left")


SCOPES = 5  # levels of items within items


def quoted_json(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def microdata(n: DataFrame) -> DataFrame:
    """(page_id, ord, source, script_id, byte_size, data): the items that a page's own attributes declare, as linked data.

    A property belongs to the nearest item around it; one outside of any is left out. A property that is an item itself is a
    value of the outer one, put together from the inside out, SCOPES levels deep; a name that comes again makes a list. One
    payload for each item that is no property of another.
    """
    a = F.col("attrs")
    scopes = n.where(F.map_contains_key("attrs", F.lit("itemscope")))
    said = n.where(F.map_contains_key("attrs", F.lit("itemprop")) | F.map_contains_key("attrs", F.lit("itemscope")))
    placed = nested(said.select("page_id", "pos", "tag", "attrs", "ancestors"), scopes)
    plain = placed.where(~F.map_contains_key("attrs", F.lit("itemscope")))
    value = F.coalesce(a["content"], F.when(F.col("tag").isin("a", "link", "area"), a["href"]).when(F.col("tag").isin("img", "audio", "video", "source", "iframe", "embed", "track"), a["src"]).when(F.col("tag") == "time", a["datetime"]).when(F.col("tag").isin("data", "meter"), a["value"]).when(F.col("tag") == "object", a["data"]))
    texts = subtree_texts(n, plain.where(value.isNull()))
    kind = F.nullif(F.regexp_extract(F.coalesce(a["itemtype"], F.lit("")), r"([^/#\s]+)/?\s*$", 1), F.lit(""))
    names = F.filter(F.split(squeezed(F.coalesce(a["itemprop"], F.lit(""))), " "), lambda x: x != "")
    rows = placed.join(texts, ["page_id", "pos"], "left").select("page_id", "pos", "holder", "holders", F.map_contains_key("attrs", F.lit("itemscope")).alias("item"), kind.alias("kind"), names.alias("names"), F.coalesce(value, "text", F.lit("")).alias("value"))
    rows = stored(rows)
    done = None
    for level in range(SCOPES - 1, -1, -1):
        held = rows.where((F.col("holders") == level + 1) & (F.size("names") > 0))
        if done is None:
            valued = held.where("not item").withColumn("json", quoted_json(F.col("value")))
        else:
            valued = held.join(done, ["page_id", "pos"], "left").withColumn("json", F.when(F.col("item"), F.col("json")).otherwise(quoted_json(F.col("value")))).where("json is not null")
        each = valued.select("page_id", F.col("holder").alias("pos"), F.col("pos").alias("at"), F.explode("names").alias("name"), "json")
        lists = each.groupBy("page_id", "pos", "name").agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("at", "json"))), lambda x: x["json"]).alias("js"))
        pair = F.concat(quoted_json(F.col("name")), F.lit(":"), F.when(F.size("js") == 1, F.col("js")[0]).otherwise(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))))
        pairs = lists.groupBy("page_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name", pair.alias("p")))), lambda x: x["p"]).alias("ps"))
        here = rows.where(F.col("item") & (F.col("holders") == level)).select("page_id", "pos", "kind").join(pairs, ["page_id", "pos"], "left")
        typed = F.when(F.col("kind").isNotNull(), F.array(F.concat(F.lit('"@type":'), quoted_json(F.col("kind"))))).otherwise(F.array().cast("array<string>"))
        done = here.select("page_id", "pos", F.concat(F.lit("{"), F.array_join(F.concat(typed, F.coalesce("ps", F.array().cast("array<string>"))), ","), F.lit("}")).alias("json"))
    return done.select("page_id", ((1 << 21) + F.col("pos")).cast("int").alias("ord"), F.lit("microdata").alias("source"), F.lit(None).cast("string").alias("script_id"), F.octet_length("json").alias("byte_size"), F.col("json").alias("data"))


def old_threads(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, html) of old thread pages -> their posts and their comments.

    posts (page_id, verdict, title, author, subreddit, score, total, body, boxes, parsed): a page without a post and a comment
    box is no thread and has no row; one whose post has none of its parts, or with boxes of which none parses, has rotted.
    comments (page_id, pos, depth, author, score, body): a box with a body of its own, depth counting the boxes around it.
    """
    n = stored(nodes(pages))  # looked at many times, parsed once
    a = F.col("attrs")
    div = n.where("tag = 'div'")
    boxes = div.where(having(a, "thing", "comment"))
    post = div.where(having(a, "thing", "link")).groupBy("page_id").agg(F.min_by(F.struct("pos", "attrs"), "pos").alias("p")).select("page_id", "p.*")
    entries = div.where(having(a, "entry"))
    typed = nested(div.where(having(a, "md")), div.where(having(a, "usertext-body"))).where("holder is not null")
    authors = n.where(F.col("tag") == "a").where(having(a, "author"))
    scores = n.where(F.col("tag") == "span").where(having(a, "score", "unvoted"))
    entry = first_inside(entries.withColumn("entry", F.col("pos")), boxes, "entry")
    of = lambda inner, name: first_inside(inner.withColumn(name, F.col("pos")), entries, name).withColumnRenamed("pos", "entry")
    found = entry.join(of(typed, "md"), ["page_id", "entry"]).join(of(authors, "by"), ["page_id", "entry"], "left").join(of(scores, "scored"), ["page_id", "entry"], "left")
    depth = nested(boxes, boxes).select("page_id", "pos", F.col("holders").alias("depth"))
    text = lambda roots, at: subtree_texts(n, roots.select("page_id", F.col(at).alias("pos"))).withColumnRenamed("pos", at)
    markup = n.select("page_id", F.col("pos").alias("md"), "start", "stop")
    html = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")

    def body(rows: DataFrame) -> DataFrame:
        """rows with md -> with body, the Markdown of the markup there."""
        cut = F.substring("html", F.col("start") + 1, F.col("stop") - F.col("start"))
        return rows.join(markup, ["page_id", "md"]).join(html, "page_id").select(*rows.columns, fragment_markdown(cut).alias("body"))

    told = n.where("tag = 'span'").select("page_id", F.col("pos").alias("scored"), F.trim(a["title"]).alias("score_title"))
    found = body(found).where("body <> ''").join(text(found, "by").withColumnRenamed("text", "author"), ["page_id", "by"], "left").join(text(found, "scored").withColumnRenamed("text", "score_text"), ["page_id", "scored"], "left").join(told, ["page_id", "scored"], "left")
    score = F.coalesce(F.when(F.col("score_title").rlike(r"^-*[0-9]+$"), F.col("score_title").try_cast("int")), _count(F.col("score_text")))
    comments = found.join(depth, ["page_id", "pos"]).select("page_id", "pos", "depth", F.coalesce(F.nullif("author", F.lit("")), F.lit("[deleted]")).alias("author"), score.alias("score"), "body")
    first = lambda inner, name: first_inside(inner.withColumn(name, F.col("pos")), post, name).select("page_id", name)
    link = lambda c: n.where("tag = 'a'").where(having(a, c))
    head = post.select("page_id", F.col("pos").alias("post"), a["data-subreddit"].alias("sub"), a["data-score"].try_cast("int").alias("score"))
    for name, inner in (("title", link("title")), ("author", authors), ("board", link("subreddit")), ("total", link("comments"))):
        spot = first(inner, "spot")
        head = head.join(spot.join(text(spot, "spot"), ["page_id", "spot"]).select("page_id", F.nullif("text", F.lit("")).alias(name)), "page_id", "left")
    own = body(first(nested(typed.drop("holder", "holders"), entries).where("holder is not null"), "md")).select("page_id", "body")
    counts = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("boxes")).join(comments.groupBy("page_id").agg(F.count(F.lit(1)).alias("parsed")), "page_id", "left")
    posts = head.join(own, "page_id", "left").join(counts, "page_id", "full")
    blank = F.col("post").isNotNull() & F.col("title").isNull() & F.col("author").isNull() & (F.coalesce("body", F.lit("")) == "")
    lost = (F.coalesce("boxes", F.lit(0)) > 0) & (F.coalesce("parsed", F.lit(0)) == 0)
    posts = posts.select("page_id", F.when(blank | lost, "rot").otherwise("ok").alias("verdict"), "title", "author", F.coalesce(F.nullif("sub", F.lit("")), F.regexp_replace("board", "^r/", "")).alias("subreddit"), "score", _count(F.col("total")).alias("total"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("parsed", F.lit(0)).alias("parsed"))
    return posts, comments


def _count(text: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, r"([0-9][0-9,]*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("int")


def old_thread_texts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(page_id, markdown) of the posts that have not rotted: head, how many of how many comments, comments set in by depth."""
    mark = F.repeat(F.lit("> "), F.col("depth") + 1)
    lines = F.array_join(F.transform(F.split("body", "\n"), lambda x: F.rtrim(F.concat(mark, x))), "\n")
    said = F.concat(lines, F.lit("\n"), F.rtrim(mark), F.lit("\n"), mark, F.lit("— u/"), "author", F.when(F.col("score").isNotNull(), F.concat(F.lit(" ("), F.col("score").cast("string"), F.lit(" points)"))).otherwise(""), F.lit("\n"))
    listed = comments.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]).alias("said"))
    p = posts.where("verdict = 'ok'").join(listed, "page_id", "left")
    meta = F.concat_ws(" · ", F.concat(F.lit("by u/"), "author"), F.concat(F.lit("in r/"), "subreddit"), F.concat(F.col("score").cast("string"), F.lit(" points")))
    of = F.when(F.col("total") > F.col("parsed"), F.concat(F.lit(" of "), F.col("total").cast("string"))).otherwise("")
    parts = F.concat(F.array(F.concat(F.lit("# "), "title", F.lit("\n")), F.concat(F.nullif(meta, F.lit("")), F.lit("\n")), F.concat(F.nullif("body", F.lit("")), F.lit("\n")), F.lit("---\n"), F.concat(F.lit("## Comments ("), F.col("parsed").cast("string"), of, F.lit(")\n")), F.lit("_Top-ranked sample from old.reddit, scored and nested._\n")), F.coalesce("said", F.array().cast("array<string>")))
    return p.select("page_id", F.concat(F.regexp_replace(F.array_join(F.array_compact(parts), "\n"), r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))
