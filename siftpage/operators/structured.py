"""Data that pages embed: found, ranked, told apart by entity, rendered, and put beside the prose."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftpage.functions.patterns import LENGTH_FLOOR
from siftpage.operators.links import joined

# Kinds whose entities carry answers, kinds of the document itself, keys that are machinery, caps.
STRONG = ["Product", "Article", "ItemList", "BreadcrumbList", "NewsArticle", "LocalBusiness", "Organization", "ContactPoint", "Event", "Recipe"]
DOCUMENT = ["Article", "NewsArticle", "BlogPosting", "WebPage", "WebSite", "BreadcrumbList", "CollectionPage", "ItemPage", "SearchResultsPage", "ImageObject", "SiteNavigationElement", "Organization", "FAQPage", "Thing"]
PROSE = ["Article", "NewsArticle"]
NOISE = ["image", "thumbnail", "thumbnailurl", "logo", "mainentityofpage"]
WINDOW_VARS = ["state", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APP_DATA__", "__APP_STATE__", "__DATA__", "__REDUX_STATE__", "__SSR__", "__APOLLO_STATE__", "__NUXT__"]
LABELS = {"recipeYield": "Yield", "prepTime": "Prep", "cookTime": "Cook", "totalTime": "Total", "recipeIngredient": "Ingredients", "recipeInstructions": "Instructions", "nutrition": "Nutrition"}
POPULATED, ENTITIES, DEPTH, ITEMS, VALUE, ROWS, COLUMNS, CELL, FIELDS, FENCE = 3, 12, 3, 10, 500, 50, 8, 200, 20, 20_000

LISTS = ["products", "items", "results", "entities", "list"]  # keys under which framework state keeps its rows, in the order they are tried
NESTED = 6  # levels below the top at which such a key is looked for
PRETTY = 20_000  # characters of an answer shown as it is

SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
META = r"(?is)<meta\b[^>]*>"
_ENTRY = "struct<key:string,value:string,kind:string>"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def is_object(v: Column) -> Column:
    return v.startswith("{") & v.endswith("}")


def is_list(v: Column) -> Column:
    return v.startswith("[") & v.endswith("]") & F.try_parse_json(v).isNotNull()


def payloads(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, ord, source, script_id, byte_size, data): JSON in scripts, and the page's own metadata.

    What does not parse, or is no object or list, is left out.
    """
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(0))).alias("ord", "tag"))
    attrs, body = F.regexp_extract("tag", SCRIPT, 1), F.trim(F.regexp_extract("tag", SCRIPT, 2))
    name, kind = _attribute(attrs, "id"), F.lower(_attribute(attrs, "type"))
    assigned = rf"(?s)window\.({'|'.join(WINDOW_VARS)})\s*=\s*(\{{.*\}})\s*;?\s*$"
    var = F.regexp_extract(body, assigned, 1)
    source = F.when(name == "__NEXT_DATA__", "next_data").when(name == "__NUXT_DATA__", "nuxt_data").when(kind == "application/ld+json", "ld_json").when((kind == "application/json") & attrs.rlike(r"(?i)\bdata-"), "generic").when(kind.isin("", "text/javascript") & (var != ""), "window_var")
    scripts = found.select("page_id", "ord", source.alias("source"), F.nullif(F.when(source == "window_var", var).otherwise(name), F.lit("")).alias("script_id"), F.when(source == "window_var", F.regexp_extract(body, assigned, 2)).otherwise(body).alias("data")).where("source is not null")
    metas = F.transform(F.regexp_extract_all("html", F.lit(META), F.lit(0)), lambda m: F.struct(_attribute(m, "property").alias("key"), _attribute(m, "content").alias("value")))
    own = F.filter(metas, lambda e: e["key"].rlike("(?i)^(og|article|product|book|profile):"))
    first = F.filter(own, lambda e, i: F.array_position(F.transform(own, lambda x: x["key"]), e["key"]) == i + 1)
    graph = pages.select("page_id", F.lit(1 << 20).alias("ord"), F.lit("opengraph").alias("source"), F.lit(None).cast("string").alias("script_id"), F.when(F.size(own) > 0, F.to_json(F.map_from_entries(first))).alias("data"))
    every = scripts.unionByName(graph).where((F.col("data").startswith("{") | F.col("data").startswith("[")) & F.try_parse_json("data").isNotNull())
    return every.select("page_id", "ord", "source", "script_id", F.octet_length("data").alias("byte_size"), "data")


def entries(data: Column) -> Column:
    """The entities of linked data as JSON texts: a list's items, and of each the members of its @graph, if it has one."""
    items = F.when(data.startswith("["), F.from_json(data, "array<string>")).otherwise(F.array(data))
    graph = lambda x: F.from_json(x, "struct<`@graph`:array<string>>")["@graph"]
    return F.filter(F.flatten(F.transform(items, lambda x: F.coalesce(graph(x), F.array(x)))), is_object)


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, also inside of a lambda, where nothing is shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(v: Column) -> Column:
    """What a JSON value is: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a kind of number."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _value(text: Column, kind: Column) -> Column:
    """A value as text, true and false with a capital."""
    return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def fields(entity: Column) -> Column:
    """(key, value, kind) of an entity in the publisher's order; values that are objects or lists are JSON texts. A text that
    only looks like an object stays a text."""
    texts, kinds = F.map_entries(F.from_json(entity, "map<string,string>")), F.map_entries(F.from_json(entity, "map<string,variant>"))
    typed = F.zip_with(texts, kinds, lambda t, k: F.struct(t["key"].alias("key"), _value(t["value"], kind_of(k["value"])).alias("value"), F.coalesce(kind_of(k["value"]), F.lit("VOID")).alias("kind")))
    return F.coalesce(typed, F.array().cast(f"array<{_ENTRY}>"))


def elements(text: Column) -> Column:
    """(value, kind) of a JSON list; null for what is none."""
    texts, kinds = F.from_json(text, "array<string>"), F.from_json(text, "array<variant>")
    return F.zip_with(texts, kinds, lambda t, k: F.struct(_value(t, kind_of(k)).alias("value"), F.coalesce(kind_of(k), F.lit("VOID")).alias("kind")))


def scalar(kind: Column) -> Column:
    return ~kind.isin("OBJECT", "ARRAY", "VOID")


def type_of(entity: Column) -> Column:
    """The entity's type, the first of several."""
    t = F.from_json(entity, "map<string,string>")["@type"]
    return F.when(t.startswith("["), F.get(F.from_json(t, "array<string>"), F.lit(0))).otherwise(t)


def answer_bearing(source: Column, data: Column) -> Column:
    """Linked data with an entity of a strong type and POPULATED fields or more."""
    full = lambda e: F.size(F.filter(fields(e), lambda f: ~f["key"].startswith("@") & ~F.coalesce(f["value"], F.lit("")).isin("", "[]", "{}"))) >= POPULATED
    strong = F.exists(entries(data), lambda e: F.coalesce(type_of(e).isin(STRONG), F.lit(False)) & full(e))
    return source.isin("ld_json", "microdata") & F.coalesce(strong, F.lit(False))


def prose_metadata(source: Column, data: Column) -> Column:
    """Linked data that says of an article what its text says too."""
    return (source == "ld_json") & F.coalesce(F.exists(entries(data), lambda e: F.coalesce(type_of(e).isin(PROSE), F.lit(False))), F.lit(False))


def ranked(found: DataFrame) -> DataFrame:
    """payloads with bucket and place: strong linked data, framework state, metadata, weak linked data, variables, the rest; the larger first."""
    strong = answer_bearing(F.col("source"), F.col("data"))
    s = F.col("source")
    bucket = F.when(strong & (s == "ld_json"), 0).when(strong, 1).when(s.isin("next_data", "nuxt_data"), 2).when(s == "opengraph", 3).when(s.isin("ld_json", "microdata"), 4).when(s == "window_var", 5).otherwise(6)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("bucket", F.desc("byte_size"), "ord"))
    return found.withColumn("strong", strong).withColumn("bucket", bucket).withColumn("place", place)


def capped(text: Column) -> Column:
    return F.when(F.length(text) > VALUE, F.concat(F.rtrim(F.left(text, F.lit(VALUE - 1))), F.lit("…"))).otherwise(text)


def _kept(f: Column) -> Column:
    return ~f["key"].startswith("@") & ~F.lower(f["key"]).isin(NOISE) & f["value"].isNotNull()


def _pairs(obj: Column) -> Column:
    """key=value of an object's scalars."""
    plain = F.filter(fields(obj), lambda e: ~e["key"].startswith("@") & scalar(e["kind"]) & (e["value"] != ""))
    return F.array_join(F.transform(plain, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def entity_text(entity: Column, kind: Column) -> Column:
    """An entity as text: a heading with its name, then every field that is not machinery; nothing for a nameless stub."""
    labels = F.create_map(*(F.lit(x) for x in chain.from_iterable(LABELS.items())))

    def line(f: Column) -> Column:
        v, label = f["value"], F.concat(F.lit("- **"), F.coalesce(labels[f["key"]], f["key"]), F.lit(":**"))

        def of_list(items: Column) -> Column:
            objects = F.slice(F.filter(items, lambda x: x["kind"] == "OBJECT"), 1, ITEMS)
            subs = F.filter(F.transform(objects, lambda x: _pairs(x["value"])), lambda s: s != "")
            scalars = F.array_join(F.transform(F.filter(items, lambda x: scalar(x["kind"]) & (x["value"] != "")), lambda x: x["value"]), ", ")
            return F.when(F.exists(items, lambda x: x["kind"] == "OBJECT"), F.concat(label, F.array_join(F.transform(subs, lambda s: F.concat(F.lit("\n  - "), s)), ""))).when(scalars != "", F.concat(label, F.lit(" "), capped(scalars)))

        of_object = bound(_pairs(v), lambda inner: F.when(inner != "", F.concat(label, F.lit(" "), inner)))
        return F.when(f["kind"] == "OBJECT", of_object).when(f["kind"] == "ARRAY", bound(elements(v), of_list)).when(v != "", F.concat(label, F.lit(" "), capped(v)))

    def text(own: Column) -> Column:
        said = lambda k: F.nullif(F.get(F.filter(own, lambda f: f["key"] == k), F.lit(0))["value"], F.lit(""))
        name = F.coalesce(said("name"), said("headline"), F.lit("unnamed"))
        lines = F.array_compact(F.transform(F.filter(own, _kept), line))
        head = F.concat(F.lit("## "), kind, F.lit(": "), name)
        return bound(lines, lambda found: F.when((F.size(found) > 0) | (name != "unnamed"), F.array_join(F.concat(F.array(head), found), "\n")))

    return bound(fields(entity), text)


def breadcrumbs(entity: Column) -> Column:
    """The names of a trail on one line; nothing without any."""
    names = F.transform(F.from_json(F.from_json(entity, "map<string,string>")["itemListElement"], "array<string>"), lambda x: F.when(is_object(x), F.from_json(x, "name string")["name"]))
    trail = lambda found: F.when(F.size(found) > 0, F.concat(F.lit("**Breadcrumbs:** "), F.array_join(found, " > ")))
    return bound(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""), trail)


def entity_texts(found: DataFrame) -> DataFrame:
    """payloads of linked data and microdata -> (page_id, ord, text): in their order the first ENTITIES entities, trails and lists,
    and how many more entities there are. A list has lines if it is priced or linked, else a table."""
    each = found.where("source in ('ld_json', 'microdata')").select("page_id", "ord", F.posexplode(entries(F.col("data"))).alias("at", "entity")).withColumn("kind", type_of(F.col("entity")))
    special = F.coalesce(F.col("kind").isin("ItemList", "BreadcrumbList"), F.lit(False))
    own = F.when(special, F.when(F.col("kind") == "ItemList", rows_text(list_rows(F.col("entity")), F.lit("ItemList"))).otherwise(breadcrumbs(F.col("entity")))).otherwise(entity_text(F.col("entity"), F.coalesce("kind", F.lit("Thing"))))
    texts = each.select("page_id", "ord", "at", special.alias("special"), own.alias("text"))
    shown = texts.withColumn("nth", F.count(F.when(~F.col("special"), F.col("text"))).over(Window.partitionBy("page_id", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    full = ~F.col("special") & (F.coalesce(F.col("nth"), F.lit(0)) >= ENTITIES)
    g = shown.groupBy("page_id", "ord").agg(F.transform(F.sort_array(F.collect_list(F.when(~full & (F.col("text") != ""), F.struct("at", "text")))), lambda x: x["text"]).alias("texts"), F.count_if(full).alias("dropped"))
    # fixed values: what is said of entities that are not shown
    note = F.when(F.col("dropped") > 0, F.concat(F.lit("_… "), F.col("dropped").cast("string"), F.when(F.col("dropped") == 1, " further structured entity not shown._").otherwise(" further structured entities not shown._")))
    return g.select("page_id", "ord", F.array_join(F.array_compact(F.array_append("texts", note)), "\n\n").alias("text")).where("text <> ''")


def flat_fields(entities: DataFrame) -> DataFrame:
    """entities (id, entity) -> (id, path, key, value): dotted and indexed keys in the publisher's order, DEPTH levels below the
    entity at most; a list's scalars are one value, its objects one key each. One explode a level, so nothing recurses."""
    todo = entities.select("id", F.array().cast("array<int>").alias("path"), F.lit("").alias("prefix"), F.col("entity").alias("object"))
    done = None
    for level in range(DEPTH + 1):
        each = todo.select("id", "path", "prefix", F.posexplode(F.filter(fields(F.col("object")), _kept)).alias("at", "f"))
        each = each.select("id", F.concat("path", F.array("at")).alias("path"), F.concat("prefix", "f.key").alias("key"), F.col("f.value").alias("v"), F.col("f.kind").alias("kind"))
        items = elements(F.col("v"))
        scalars = F.transform(F.filter(items, lambda x: ~x["kind"].isin("OBJECT", "ARRAY") & (F.coalesce(x["value"], F.lit("None")) != "")), lambda x: F.coalesce(x["value"], F.lit("None")))
        value = F.when(F.col("kind") == "OBJECT", F.lit(None)).when(F.col("kind") == "ARRAY", F.when(F.size(scalars) > 0, capped(F.array_join(F.slice(scalars, 1, ITEMS), "; ")))).when(F.col("v") != "", capped(F.col("v")))
        rows = each.select("id", "path", "key", value.alias("value")).where("value is not null")
        done = rows if done is None else done.union(rows)
        if level < DEPTH:
            within = F.transform(F.slice(items, 1, ITEMS), lambda x, i: F.struct(i.alias("i"), F.concat(F.col("key"), F.lit("["), i.cast("string"), F.lit("].")).alias("prefix"), x["value"].alias("object"), x["kind"].alias("kind")))
            lists = F.when((F.col("kind") == "ARRAY") & (F.size(scalars) == 0), F.filter(within, lambda w: w["kind"] == "OBJECT"))
            one = F.when(F.col("kind") == "OBJECT", F.array(F.struct(F.lit(0).alias("i"), F.concat("key", F.lit(".")).alias("prefix"), F.col("v").alias("object"), F.col("kind").alias("kind"))))
            todo = each.select("id", "path", F.explode(F.coalesce(one, lists)).alias("w")).select("id", F.concat("path", F.array("w.i")).alias("path"), "w.prefix", "w.object")
    return done


def subject_entities(found: DataFrame) -> DataFrame:
    """(page_id, type, n_fields, omitted, fields): of what a page declares on its subject the entity with most fields, the first
    among equals; FIELDS of its fields are kept and the rest counted."""
    r = ranked(found).where("source in ('ld_json', 'microdata')")
    each = r.select("page_id", "place", F.posexplode(entries(F.col("data"))).alias("at", "entity")).withColumn("type", type_of(F.col("entity"))).where(F.col("type").isNotNull() & ~F.col("type").isin(DOCUMENT))
    each = each.withColumn("id", F.struct("page_id", "place", "at"))
    flat = flat_fields(each.select("id", "entity")).groupBy("id").agg(F.count(F.lit(1)).alias("n_fields"), F.transform(F.sort_array(F.collect_list(F.struct("path", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("all"))
    best = Window.partitionBy("page_id").orderBy(F.desc("n_fields"), "place", "at")
    top = each.join(flat, "id").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return top.select("page_id", "type", "n_fields", F.greatest(F.col("n_fields") - FIELDS, F.lit(0)).alias("omitted"), F.slice("all", 1, FIELDS).alias("fields"))


ROW = "name string, headline string, title string, url string, price string, currency string, rating string, stock string, seller string, offers string, aggregateRating string"


def commerce(row: Column) -> Column:
    """struct(name, url, price, currency, rating, stock, seller) of a listed item: its own fields, else those of its offer and rating."""
    filled = lambda c: F.nullif(c, F.lit(""))

    def of(x: Column) -> Column:
        r, o, rating = x["r"], x["o"], x["rating"]
        seller = F.when(is_object(o["seller"]), F.get_json_object(o["seller"], "$.name")).otherwise(o["seller"])
        lifted = r["price"].isNull() & o["price"].isNotNull()
        return F.struct(
            F.coalesce(filled(r["name"]), filled(r["headline"]), filled(r["title"])).alias("name"), F.coalesce(filled(r["url"]), filled(o["url"])).alias("url"), F.coalesce(r["price"], o["price"]).alias("price"), F.coalesce(r["currency"], F.when(lifted, filled(o["priceCurrency"]))).alias("currency"),
            F.coalesce(r["rating"], rating["ratingValue"]).alias("rating"), F.coalesce(r["stock"], filled(F.substring_index(o["availability"], "/", -1))).alias("stock"), F.coalesce(r["seller"], filled(seller)).alias("seller"),
        )

    offer = lambda r: F.from_json(r["offers"], "price string, priceCurrency string, url string, availability string, seller string")
    return bound(bound(F.from_json(row, ROW), lambda r: F.struct(r.alias("r"), offer(r).alias("o"), F.from_json(r["aggregateRating"], "ratingValue string").alias("rating"))), of)


def list_rows(entity: Column) -> Column:
    """The items of a list of linked data as JSON texts."""
    items = F.from_json(F.from_json(entity, "map<string,string>")["itemListElement"], "array<string>")
    own = F.transform(F.filter(items, lambda i: F.coalesce(is_object(i), F.lit(False))), lambda i: F.coalesce(F.from_json(i, "map<string,string>")["item"], i))
    return F.filter(own, is_object)


def framework_lists(found: DataFrame) -> DataFrame:
    """payloads of framework state -> (page_id, ord, rows): of the first list of objects under one of LISTS its first ROWS.

    The search goes down every branch before the next one, tries the keys of an object before what is in it, and looks NESTED
    levels deep. A place in it is the array of the places on the way down, and such arrays sort depth first, what holds
    before what is held; so all levels are taken apart at once and the first find is the smallest place.
    """
    todo = found.where(F.col("source").isin("next_data", "nuxt_data", "window_var", "generic")).select("page_id", "ord", F.array().cast("array<int>").alias("path"), F.col("data").alias("v"))
    hits = None
    for level in range(NESTED + 1):
        at = F.from_json("v", "map<string,string>")
        candidate = lambda k: F.struct(F.lit(LISTS.index(k)).alias("rank"), F.when(F.col("v").startswith("{"), elements(at[k])).alias("rows"))
        whole = lambda c: (F.size(c["rows"]) > 0) & F.forall(c["rows"], lambda x: x["kind"] == "OBJECT")
        first = F.get(F.filter(F.array(*map(candidate, LISTS)), whole), F.lit(0))
        level_hits = todo.select("page_id", "ord", "path", first["rows"].alias("rows")).where("rows is not null")
        hits = level_hits if hits is None else hits.union(level_hits)
        if level < NESTED:
            inner = F.when(F.col("v").startswith("{"), F.transform(fields(F.col("v")), lambda f: F.struct(f["value"].alias("value"), f["kind"].alias("kind")))).otherwise(elements(F.col("v")))
            below = F.filter(F.transform(inner, lambda x, i: F.struct(i.alias("i"), x["value"].alias("value"), x["kind"].alias("kind"))), lambda x: x["kind"].isin("OBJECT", "ARRAY"))
            todo = todo.select("page_id", "ord", "path", F.explode(below).alias("b")).select("page_id", "ord", F.concat("path", F.array("b.i")).alias("path"), F.col("b.value").alias("v"))
    rows = F.transform(F.slice("rows", 1, ROWS), lambda x: x["value"])
    return hits.groupBy("page_id", "ord").agg(F.min_by(rows, "path").alias("rows"))


def listings(found: DataFrame) -> DataFrame:
    """payloads -> (page_id, ord, title, rows): the rows behind them, of every list of linked data and microdata, or of framework state."""
    linked = found.where("source in ('ld_json', 'microdata')").select("page_id", "ord", F.posexplode(entries(F.col("data"))).alias("at", "e")).where(type_of(F.col("e")) == "ItemList").select("page_id", "ord", "at", list_rows(F.col("e")).alias("rows"))
    linked = linked.groupBy("page_id", "ord").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "rows"))), lambda x: x["rows"])).alias("rows"))
    state = framework_lists(found)
    return linked.select("page_id", "ord", F.lit("ItemList").alias("title"), "rows").union(state.select("page_id", "ord", F.lit("Listings").alias("title"), "rows"))


def listing_rows(found: DataFrame) -> DataFrame:
    """(page_id, ord, pos, row, c): the rows behind every payload, and of each its commerce fields."""
    each = listings(found).select("page_id", "ord", F.posexplode("rows").alias("pos", "row"))
    return each.withColumn("c", commerce(F.col("row")))


def records_of(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """listing_rows() and pages (page_id, url) -> (page_id, ord, pos, title, link, text): rows as records, their links resolved
    against the page; a row without a URL stays without a link, one without a name and a URL goes."""
    c = F.col("c")
    named = rows.where("c.name is not null or c.url is not null").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    title = F.coalesce(F.trim(F.regexp_replace(c["name"], r"\s+", " ")), c["url"])
    price = F.when(F.coalesce(c["price"], F.lit("")) != "", F.concat_ws(" ", c["price"], F.nullif(c["currency"], F.lit(""))))
    extras = F.concat_ws(" ", price, F.nullif(c["rating"], F.lit("")))
    text = F.concat(title, F.when(extras != "", F.concat(F.lit(" — "), extras)).otherwise(""))
    return named.select("page_id", "ord", "pos", title.alias("title"), F.when(c["url"].isNotNull(), joined(F.col("base"), c["url"])).alias("link"), text.alias("text"))


def lifted(own: Column, c: Column) -> Column:
    """fields() of a row with what its offer and rating say put in: in place where the row has the key, else behind."""
    text = lambda k, v: F.struct(k.alias("key"), v.alias("value"), F.lit("STRING").alias("kind"))

    def put(x: Column) -> Column:
        own, said = x["own"], x["said"]
        of = lambda k: F.get(F.filter(said, lambda e: e["key"] == k), F.lit(0))["value"]
        blank = lambda f: (f["kind"] == "VOID") | ((f["key"] == "url") & (F.coalesce(f["value"], F.lit("")) == ""))
        mine = F.transform(own, lambda f: F.when(blank(f) & of(f["key"]).isNotNull(), text(f["key"], of(f["key"]))).otherwise(f))
        return F.concat(mine, F.filter(said, lambda e: ~F.exists(own, lambda f: f["key"] == e["key"])))

    said = F.filter(F.array(*(text(F.lit(k), c[k]) for k in ("price", "currency", "url", "stock", "seller", "rating"))), lambda e: e["value"].isNotNull())
    return bound(F.struct(own.alias("own"), said.alias("said")), put)


def rows_text(rows: Column, title: Column) -> Column:
    """Rows as lines with links where half of them have a price or a URL, else as a table."""

    def text(xs: Column) -> Column:
        priced = F.size(F.filter(xs, lambda x: x["c"]["price"].isNotNull() | x["c"]["url"].isNotNull()))
        lines = F.array_compact(F.transform(F.slice(xs, 1, ROWS), lambda x: record_line(x["c"])))
        listed = bound(lines, lambda found: F.when(F.size(found) > 0, F.concat(F.lit("### "), title, F.lit("\n\n"), F.array_join(found, "\n"))))
        table = table_text(F.transform(xs, lambda x: lifted(x["own"], x["c"])), title)
        return F.when(F.size(xs) > 0, F.when(2 * priced >= F.size(xs), listed).otherwise(table))

    return bound(F.transform(rows, lambda r: F.struct(fields(r).alias("own"), commerce(r).alias("c"))), text)


def payload_texts(found: DataFrame) -> DataFrame:
    """payloads -> (page_id, ord, source, text): each as text by what it is; those that are no known shape have none."""
    state = framework_lists(found).select("page_id", "ord", rows_text(F.col("rows"), F.lit("Listings")).alias("text"))
    graph = found.where("source = 'opengraph'").select("page_id", "ord", graph_text(F.col("data")).alias("text"))
    return entity_texts(found).union(state).union(graph).where("text <> ''").join(found.select("page_id", "ord", "source"), ["page_id", "ord"]).select("page_id", "ord", "source", "text")


def _fence(text: str | None) -> str | None:
    try:
        shown = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None
    return "```json\n" + (shown if len(shown) <= PRETTY else shown[:PRETTY] + "\n… (truncated)") + "\n```"


def fenced(data: Column) -> Column:
    """A JSON answer of no known shape as it is, set in by two and cut after PRETTY characters; null for what is no JSON."""
    return F.pandas_udf(lambda texts: texts.map(_fence), StringType())(data)


def record_line(c: Column) -> Column:
    """An item as a line with its link, price and rating; nothing without a name and a URL."""
    plain = lambda t: F.trim(F.regexp_replace(F.translate(t, "[]", ""), r"\s+", " "))
    head = F.when(c["url"].isNotNull() & c["name"].isNotNull(), F.concat(F.lit("["), plain(c["name"]), F.lit("]("), c["url"], F.lit(")"))).when(c["name"].isNotNull(), plain(c["name"])).otherwise(c["url"])
    price = F.when(F.coalesce(c["price"], F.lit("")) != "", F.concat_ws(" ", c["price"], F.nullif(c["currency"], F.lit(""))))
    rating = F.when(F.coalesce(c["rating"], F.lit("")) != "", F.concat(F.lit("⭐ "), c["rating"]))
    extras = F.concat_ws(" ", price, rating)
    return F.when(head.isNotNull(), F.concat(F.lit("- "), head, F.when(extras != "", F.concat(F.lit(" — "), extras)).otherwise("")))


def commerce_lists(rows: DataFrame) -> DataFrame:
    """(page_id, ord, shaped, text): is half of a list priced or linked, and then its first ROWS items as lines."""
    hit = F.col("c.price").isNotNull() | F.col("c.url").isNotNull()
    line = F.when(F.col("pos") < ROWS, record_line(F.col("c")))
    g = rows.groupBy("page_id", "ord").agg((2 * F.count_if(hit) >= F.count(F.lit(1))).alias("shaped"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line"))))), lambda x: x["line"]), "\n").alias("lines"))
    return g.select("page_id", "ord", "shaped", F.when(F.col("shaped") & (F.col("lines") != ""), F.concat(F.lit("### ItemList\n\n"), "lines")).alias("text"))


def table_text(rows: Column, title: Column) -> Column:
    """rows: array of arrays of (key, value, kind) -> a table: COLUMNS of the union of all rows' keys, ROWS rows, cells of CELL characters."""
    # a fixed value: what is said of rows that are not shown
    more = lambda rows: F.when(F.size(rows) > ROWS, F.concat(F.lit(f"\n\n_Showing {ROWS} of "), F.size(rows).cast("string"), F.lit(" rows — this is a partial view._"))).otherwise("")
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    cell = lambda r, k: F.left(F.replace(F.coalesce(F.get(F.filter(r, lambda e: e["key"] == k), F.lit(0))["value"], F.lit("")), F.lit("|"), F.lit("/")), F.lit(CELL))

    def text(x: Column) -> Column:
        rows, keys = x["rows"], x["keys"]
        body = F.transform(F.slice(rows, 1, ROWS), lambda r: bar(F.transform(keys, lambda k: cell(r, k))))
        lines = F.concat(F.array(bar(keys), bar(F.transform(keys, lambda k: F.lit("---")))), body)
        return F.when(F.size(keys) > 0, F.concat(F.lit("### "), title, F.lit("\n\n"), F.array_join(lines, "\n"), more(rows)))

    plain = F.transform(rows, lambda r: F.filter(r, lambda e: ~e["key"].startswith("@") & ~e["kind"].isin("OBJECT", "ARRAY")))
    keys = lambda rows: F.slice(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda e: e["key"])))), 1, COLUMNS)
    return bound(bound(plain, lambda rows: F.struct(rows.alias("rows"), keys(rows).alias("keys"))), text)


def graph_text(data: Column) -> Column:
    """A page's own metadata as a table of two columns."""
    cell = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit("STRING").alias("kind"))
    return table_text(F.transform(fields(data), lambda e: F.array(cell("property", e["key"]), cell("value", e["value"]))), F.lit("OpenGraph"))


def bodies(candidates: DataFrame) -> DataFrame:
    """candidates (page_id, ord, source, content, answer_bearing, prose_metadata) -> (page_id, body, menu).

    A set of records is the body. Where the prose is too short to be any, the first candidate that bears an answer is, else
    all structured ones, else what there is. Real prose takes the first structured one along unless that only repeats what an
    article says of itself. The menu is every candidate under a label. Of each list whatever is part of another member, by
    words, is left out. One aggregate a page; no candidate is dropped for its length.
    """
    c = F.col
    item = F.struct("ord", "source", "content", "answer_bearing", "prose_metadata")
    g = candidates.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    norm = lambda x: F.trim(F.regexp_replace(x["content"], r"\s+", " "))
    filled = lambda xs: F.filter(xs, lambda x: F.coalesce(x["content"], F.lit("")) != "")

    def whole(xs: Column) -> Column:
        inside = lambda x, i: F.exists(F.transform(xs, lambda y, j: F.struct(norm(y).alias("n"), j.alias("j"))), lambda y: (F.contains(y["n"], norm(x)) & (y["n"] != norm(x))) | ((y["n"] == norm(x)) & (y["j"] < i)))
        return F.filter(xs, lambda x, i: ~inside(x, i))

    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["content"]), "\n\n")
    of = lambda s: F.filter(filled(c("all")), lambda x: x["source"] == s)
    first = lambda xs: F.get(xs, F.lit(0))
    prose, json, records = first(of("prose")), of("json_synth"), first(of("record_synth"))
    answer = first(F.filter(filled(c("all")), lambda x: x["answer_bearing"]))
    thin = F.coalesce(F.length(prose["content"]), F.lit(0)) < LENGTH_FLOOR
    both = F.when((F.size(json) > 0) & ~F.coalesce(first(json)["prose_metadata"], F.lit(False)), text(whole(F.array(prose, first(json))))).otherwise(prose["content"])
    body = F.coalesce(records["content"], F.when(thin, F.coalesce(answer["content"], F.when(F.size(json) > 0, text(whole(json))), prose["content"], first(filled(c("all")))["content"])).otherwise(both), F.lit(""))
    label = lambda x: F.when(x["source"] == "prose", "## source: prose").when(x["source"] == "json_synth", "## source: structured (json)").when(x["source"] == "record_synth", "## source: structured (records)").otherwise(F.concat(F.lit("## source: "), x["source"]))
    menu = F.array_join(F.transform(whole(filled(c("all"))), lambda x: F.concat(label(x), F.lit("\n\n"), x["content"])), "\n\n")
    return g.select("page_id", body.alias("body"), menu.alias("menu"))
