"""Links of a page: taken out, resolved, one handle for each target, and the lists that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGEST_CAP, NEXT_CAP = 200, 10

# Path segments of searches, schemes that are contacts or nothing to fetch, hosts of archives and of searches
# that answer with captchas, reasons that say nothing of the page itself.
SEARCH_SEGMENTS = ["search", "arama", "ara", "results", "sr", "find", "query"]
CONTACT, UNFETCHABLE = r"(?i)^(mailto|tel):", r"(?i)^(javascript|data|blob|about):"
ARCHIVES = ["web.archive.org", "archive.org", "ghostarchive.org", "archive.ph", "archive.today", "archive.is"]
GENERIC_REASONS = ["discussed page", "item page", "discussion thread"]
COMMENTS = r"(?i)\b\d+\s*comments?\b"
_HREF = r"""<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>"""
_ANCHOR, _OPENING, _ENDS = rf"(?is){_HREF}(.*?)</a>", rf"(?is)^{_HREF}", rf"(?is)^{_HREF}|</a>$"
HANDLE = r"\{\{(\d+)\}\}"


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(netloc(url))


def hostname(url: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def site(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(F.regexp_replace(host(url), r"^www\.", ""), ".", -2)


def normalised(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/+$", "")


def under(name: Column, hosts: list[str]) -> Column:
    """The host is one of these or a subdomain of one."""
    any_of = F.lit(False)
    for h in hosts:
        any_of = any_of | (name == h) | name.endswith("." + h)
    return any_of


def search_shaped(url: Column) -> Column:
    """It has a query, or a path segment that searches have."""
    return (query_string(url) != "") | F.arrays_overlap(F.split(F.lower(path(url)), "/"), F.array(*map(F.lit, SEARCH_SEGMENTS)))


def archive_mirror(url: Column) -> Column:
    return hostname(url).isin(ARCHIVES) | hostname(url).endswith(".archive.org")


def _folded(p: Column) -> Column:
    """An absolute path without dot segments."""
    parts = F.slice(F.split(p, "/"), 2, 1 << 20)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    step = lambda a, s: F.when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).when(s == ".", a).otherwise(F.concat(a, F.lit("/"), s))
    folded = F.concat(F.aggregate(parts, F.lit(""), step), end)
    return F.when(F.contains(p, F.lit("/.")), F.regexp_replace(folded, "^$", "/")).when(p == "", "/").otherwise(p)


def _merged(base: Column, own: Column) -> Column:
    """The path of base's directory and own after it, empty segments left out but for the last: what is written as an absolute
    path keeps its own."""
    whole = F.concat(F.regexp_replace(path(base), "[^/]*$", ""), own)
    whole = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    return F.regexp_replace(whole, "/{2,}", "/")


def joined(base: Column, href: Column) -> Column:
    """href as seen from the page at base: absolute as it is, else with base's scheme, host and directory."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    own, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    out = F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href == "", base)
    out = out.when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href)).when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
    return out.otherwise(F.concat(root, _folded(F.when(own.startswith("/"), own).otherwise(_merged(base, own))), tail))


def served_elsewhere(requested: Column, served: Column) -> Column:
    """Whether what was served is of another site than what was asked for; redirects within a site are none."""
    filled = (F.coalesce(requested, F.lit("")) != "") & (F.coalesce(served, F.lit("")) != "")
    return filled & (site(requested) != site(served))


def target_key(url: Column) -> Column:
    """Scheme, host, path without trailing slashes, and query."""
    p = F.regexp_replace(path(url), "/+$", "")
    q = query_string(url)
    return F.concat(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), F.lit("://"), netloc(url), F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def resolved(base: Column, href: Column) -> Column:
    """struct(key, href, is_contact) of a link of the page at base; null for links that lead nowhere or to the page itself.

    Contacts stay as they are written. Empty links, fragments alone, schemes that cannot be fetched and other schemes than
    http and https are cut.
    """
    row = lambda k, h, c: F.struct(k.alias("key"), h.alias("href"), F.lit(c).alias("is_contact"))
    # what several tests read is worked out once, by way of an array of one
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def fetched(raw: Column) -> Column:
        of = lambda absolute: once(target_key(absolute), lambda key: F.when(absolute.rlike("(?i)^https?://") & (key != target_key(base)), row(key, absolute, False)))
        return F.when((raw != "") & ~raw.rlike(UNFETCHABLE) & ~raw.startswith("#"), once(joined(base, raw), of))

    return once(F.trim(F.coalesce(href, F.lit(""))), lambda raw: F.when(raw.rlike(CONTACT), row(raw, raw, True)).otherwise(fetched(raw)))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label) of every <a href>, in page order; label without tags, white space collapsed."""
    each = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("pos", "a"))
    part = lambda k: F.regexp_extract("a", _OPENING, k)
    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("a", _ENDS, ""), r"(?s)<[^>]+>", " "), r"\s+", " "))
    return each.select("page_id", "url", "pos", F.concat(part(1), part(2), part(3)).alias("href"), label.alias("label"))


def digest(links: DataFrame, cap: int = DIGEST_CAP) -> DataFrame:
    """(page_id, url, pos, href, label) -> (page_id, handle, labels, href, off_domain, is_contact).

    One handle for each target in first-seen order, `cap` at most; labels are the different ones that are not empty, in order
    of first use; href is the first one written for the target.
    """
    row = resolved(F.col("url"), F.col("href"))
    a = links.select("page_id", "url", "pos", F.trim("label").alias("label"), F.explode(F.array_compact(F.array(row))).alias("r"))  # no filter, which would work the row out again
    labels = F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), lambda x: x != ""))
    one = a.groupBy("page_id", "url", F.col("r.key").alias("key")).agg(F.min(F.struct("pos", "r.href", "r.is_contact")).alias("first"), labels.alias("labels"))
    one = one.withColumn("handle", F.row_number().over(Window.partitionBy("page_id").orderBy("first.pos"))).where(F.col("handle") <= cap)
    contact, href = F.col("first.is_contact"), F.col("first.href")
    return one.select("page_id", "handle", "labels", href.alias("href"), (~contact & (site(href) != site(F.col("url")))).alias("off_domain"), contact.alias("is_contact"))


def rendered(handle: Column, labels: Column, href: Column, off_domain: Column, is_contact: Column) -> Column:
    """A line of the digest: the handle, its labels, and the path; the host only where it is another's."""
    shown = F.when(path(href) == "", "/").otherwise(path(href))
    shown = F.concat(F.when(off_domain, netloc(href)).otherwise(""), shown, F.when(query_string(href) != "", F.concat(F.lit("?"), query_string(href))).otherwise(""))
    label = F.when(F.size(labels) > 0, F.array_join(labels, " / ")).otherwise("(no label)")
    return F.concat(F.lit("{{"), handle.cast("string"), F.lit("}} "), label, F.lit(" · "), F.when(is_contact, href).otherwise(shown))


def rehydrated(text: Column, table: Column) -> Column:
    """text with every {{n}} replaced by table[n], or by nothing where the map has no n."""
    step = lambda t, h: F.replace(t, F.concat(F.lit("{{"), h, F.lit("}}")), F.coalesce(F.try_element_at(table, h.cast("int")), F.lit("")))
    return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(1))), text, step)


def handled_pages(entries: DataFrame, table: DataFrame) -> DataFrame:
    """entries (page_id, pos, handle, url, reason, kind) with the digest's href for a handle; unknown handles and entries with
    neither are dropped, never guessed."""
    known = table.select("page_id", "handle", F.col("href").alias("real"), "off_domain")
    both = entries.join(known, ["page_id", "handle"], "left").where("real is not null or (handle is null and url <> '')")
    return both.select("page_id", "pos", F.coalesce("real", "url").alias("url"), "reason", "kind", F.coalesce("off_domain", F.lit(False)).alias("off_domain"))


def grounded(links: DataFrame, bodies: DataFrame, handler_links: DataFrame) -> DataFrame:
    """links (page_id, pos, url, ..) of a model, with kept: its URL stands in the body, or a handler gave it too."""
    given = handler_links.select("page_id", "url").distinct().withColumn("given", F.lit(True))
    seen = links.join(bodies.select("page_id", "markdown"), "page_id", "left").join(given, ["page_id", "url"], "left")
    kept = F.coalesce(F.contains("markdown", "url"), F.lit(False)) | F.coalesce("given", F.lit(False))
    return seen.select(*[seen[c] for c in links.columns], kept.alias("kept"))


def composed(model_links: DataFrame, handler_links: DataFrame, cap: int = NEXT_CAP) -> DataFrame:
    """(page_id, pos, url, ..) twice -> (page_id, place, url, ..): the model's links, then those of the handler that it left out."""
    missing = handler_links.join(model_links.select("page_id", "url").distinct(), ["page_id", "url"], "left_anti").select(*handler_links.columns)
    both = model_links.withColumn("part", F.lit(0)).unionByName(missing.withColumn("part", F.lit(1)))
    both = both.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("part", "pos"))).where(F.col("place") <= cap)
    return both.select("page_id", "place", *[c for c in model_links.columns if c not in ("page_id", "pos")])


def merged_pages(rows: DataFrame, cap: int = NEXT_CAP) -> DataFrame:
    """(page_id, pos, url, reason, kind) -> one row a URL with its place.

    A reason of the page's own beats a generic one; among equals structural beats drilldown, then the earlier stands. The
    order is that of first sight.
    """
    generic, weaker = F.col("reason").isin(GENERIC_REASONS).cast("int"), F.when(F.col("kind") == "structural", 0).otherwise(1)
    best = rows.groupBy("page_id", "url").agg(F.min("pos").alias("seen"), F.min_by(F.struct("reason", "kind"), F.struct(generic, weaker, "pos")).alias("b"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("seen"))
    return best.select("page_id", place.alias("place"), "url", "b.reason", "b.kind").where(F.col("place") <= cap)


def record_links(records: DataFrame) -> DataFrame:
    """records (page_id, url, pos, heading {anchor, href}, links array of the same) -> (page_id, pos, part, anchor, url, reason, kind).

    A heading that leads on within the host is the item's own page (drilldown), one that leads away the page that is
    discussed (source). A link of the same host that counts comments is the discussion. Archive mirrors and URLs seen before
    are left out.
    """
    own = hostname(F.col("url"))
    to = hostname(F.col("heading.href"))
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    inside = (to == "") | (bare(to) == bare(own))
    heading = F.struct("heading.anchor", "heading.href", F.when(inside, "drilldown").otherwise("source").alias("kind"), F.when(inside, "item page").otherwise("discussed page").alias("reason"))
    talk = F.get(F.filter("links", lambda x: x["anchor"].rlike(COMMENTS) & ((hostname(x["href"]) == "") | (hostname(x["href"]) == own))), F.lit(0))
    discussion = F.struct(talk["anchor"].alias("anchor"), talk["href"].alias("href"), F.lit("discussion").alias("kind"), F.lit("discussion thread").alias("reason"))
    each = records.select("page_id", "pos", F.posexplode(F.array(heading, discussion)).alias("part", "c")).where("c.href is not null").where(~archive_mirror(F.col("c.href")))
    first = Window.partitionBy("page_id", "c.href").orderBy("pos", "part")
    each = each.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    anchor = F.when(F.coalesce("c.anchor", F.lit("")) == "", F.col("c.href")).otherwise(F.col("c.anchor"))
    return each.select("page_id", "pos", "part", F.left(anchor, F.lit(120)).alias("anchor"), F.col("c.href").alias("url"), "c.reason", "c.kind")
