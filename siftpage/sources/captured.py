"""Readers of captured material: exchanges, corpora, gold texts, feeds. Files are read by Spark, whatever store they are in."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    import yaml
except ImportError:  # JSON, which is YAML too, is read without
    yaml = None

SEPARATOR = "\n===== exchange =====\n"
HEADERS, BODY, REQUEST = "--- headers ---", "--- body ---", ">>> GET "


def _pairs(block: Column) -> Column:
    """The `key: value` lines of a block as a map; of repeated keys the last counts."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def exchanges(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Captured exchanges of the files under path -> (file, pos, url, status, verdict, content_type, final_url, conditional_hit, headers, body).

    An exchange without its marks, and a 304 without a body, which only points to a copy that is not here, raise an error.
    Bodies are bytes, written as UTF-8 text or base64. Empty files have no exchanges.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parts = files.where(F.col("value").rlike(r"\S")).select("file", F.posexplode(F.split("value", re.escape(separator))).alias("pos", "chunk"))
    marks = F.instr("chunk", "\n" + BODY)
    whole = F.col("chunk").startswith(REQUEST) & (marks > 0) & F.contains(F.substring_index("chunk", "\n" + BODY, 1), F.lit("\n" + HEADERS))
    parts = parts.withColumn("chunk", F.when(whole, F.col("chunk")).otherwise(F.raise_error(F.concat(F.lit("malformed exchange in "), "file"))))
    head = F.substring_index("chunk", "\n" + BODY, 1)
    body = F.regexp_replace(F.substring(F.col("chunk"), marks + len(BODY) + 1, F.length("chunk")), "^\n", "")
    meta = _pairs(F.regexp_replace(F.substring_index(head, "\n" + HEADERS, 1), "^[^\n]*", ""))
    read = parts.select("file", "pos", F.regexp_extract("chunk", f"^{re.escape(REQUEST)}([^\n]*)", 1).alias("url"), meta.alias("m"), _pairs(F.substring_index(head, "\n" + HEADERS, -1)).alias("headers"), body.alias("text"))
    m = lambda k: F.try_element_at("m", F.lit(k))
    data = F.when(m("body-encoding") == "base64", F.unbase64(F.regexp_replace("text", r"\s", ""))).otherwise(F.encode("text", "UTF-8"))
    status, hit = F.coalesce(m("status").try_cast("int"), F.lit(0)), F.coalesce(m("conditional-hit") == "true", F.lit(False))
    out = read.select("file", "pos", "url", status.alias("status"), F.coalesce(m("verdict"), F.lit("ok")).alias("verdict"), F.coalesce(m("content-type"), F.lit("")).alias("content_type"), F.coalesce(m("final-url"), F.col("url")).alias("final_url"), hit.alias("conditional_hit"), "headers", data.alias("body"))
    pointer = (F.col("status") == 304) & F.col("conditional_hit") & (F.octet_length("body") == 0)
    return out.withColumn("body", F.when(pointer, F.raise_error(F.concat(F.lit("a 304 without a body for "), "url")).cast("binary")).otherwise(F.col("body")))


def latest_exchanges(found: DataFrame) -> DataFrame:
    """One exchange a URL in a file: the last one written."""
    return found.groupBy("file", "url").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("file", "url")]), "pos").alias("x")).select("file", "url", "x.*")


def _json(text: str | None) -> str | None:
    """A YAML document as JSON; what is JSON already stays, dates become texts, what is neither is null."""
    try:
        json.loads(text or "")
        return text
    except ValueError:
        pass
    try:
        return json.dumps(yaml.safe_load(text or ""), ensure_ascii=False, default=str) if yaml else None
    except yaml.YAMLError:
        return None


def as_json(text: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(_json), StringType())(text)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """The members of `urls` of YAML or JSON documents as maps of JSON texts, in order; file is where they come from."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json(as_json(F.col("value")), "urls array<map<string,string>>")["urls"].alias("urls"))
    listed = F.when(F.coalesce(F.size("urls"), F.lit(0)) > 0, F.col("urls")).otherwise(F.raise_error(F.concat("file", F.lit(" has no `urls` list, or an empty one"))).cast("array<map<string,string>>"))
    return whole.select("file", F.posexplode(listed).alias("pos", "row"))


def _required(name: str, bad: Column | None = None) -> Column:
    value = F.try_element_at("row", F.lit(name))
    missing = value.isNull() if bad is None else value.isNull() | bad
    return F.when(~missing, value).otherwise(F.raise_error(F.concat("file", F.lit(": row "), F.col("pos").cast("string"), F.lit(f" has no valid {name}")))).alias(name)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(pos, slug, url, task, criteria, class, needs): an evaluation corpus. A row without a required field or criteria raises."""
    rows = _documents(spark, path)
    criteria = F.from_json(F.try_element_at("row", F.lit("criteria")), "array<string>")
    listed = F.when(F.coalesce(F.size(criteria), F.lit(0)) > 0, criteria).otherwise(F.raise_error(F.concat("file", F.lit(": row "), F.col("pos").cast("string"), F.lit(" has no valid criteria"))).cast("array<string>"))
    needs = F.coalesce(F.from_json(F.try_element_at("row", F.lit("needs")), "array<string>"), F.array().cast("array<string>"))
    return rows.select("pos", _required("slug"), _required("url"), _required("task"), listed.alias("criteria"), F.coalesce(F.try_element_at("row", F.lit("class")), F.lit("")).alias("class"), needs.alias("needs"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(pos, slug, url, gold_md, class): gold texts. A row without one, or with a blank one, raises."""
    blank = F.trim(F.try_element_at("row", F.lit("gold_md"))) == ""
    return _documents(spark, path).select("pos", _required("slug"), _required("url"), _required("gold_md", blank), F.coalesce(F.try_element_at("row", F.lit("class")), F.lit("")).alias("class"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, name, content) of every file of the cases under folder: folder/slug/case.json, baseline/*, inputs/*."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.regexp_extract("path", rf"{re.escape(folder.rstrip('/').split('/')[-1])}/(.*)$", 1)
    return files.select(F.substring_index(at, "/", 1).alias("slug"), F.regexp_replace(at, "^[^/]*/", "").alias("name"), "content")


CASE = "slug string, url string, question string, failure_class string, tags array<string>, notes string"
META = "captured_at string, source_url string, layers map<string,string>, content_sha256 string"


def case_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case under folder: slug, what the case says of itself, what its capture says, its contract as (key, JSON value)
    pairs, and whether the captured copy is of another address than the case asks for. A case without case.yaml or case.json
    raises; a capture or a contract may be missing."""
    files = cases(spark, folder).select("slug", "name", as_json(F.decode("content", "UTF-8")).alias("text"))
    of = lambda *names: F.max(F.when(F.col("name").isin(*names), F.col("text")))
    g = files.where(F.col("name").isin("case.yaml", "case.json", "meta.yaml", "meta.json", "baseline/contract.json")).groupBy(F.col("slug").alias("folder")).agg(of("case.yaml", "case.json").alias("case"), of("meta.yaml", "meta.json").alias("meta"), of("baseline/contract.json").alias("contract"))
    case = F.coalesce(F.col("case"), F.raise_error(F.concat(F.lit("no case in "), "folder")))
    rows = g.select("folder", F.from_json(case, CASE).alias("c"), F.from_json("meta", META).alias("m"), F.map_entries(F.from_json("contract", "map<string,string>")).alias("contract"))
    other = F.col("m.source_url").isNotNull() & (F.col("m.source_url") != F.col("c.url"))
    return rows.select(F.coalesce("c.slug", "folder").alias("slug"), "c.url", "c.question", "c.failure_class", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), "m.captured_at", "m.content_sha256", F.coalesce(other, F.lit(False)).alias("moved"), "contract")


ATOM = "title string, entry array<struct<id:string,title:string,author:struct<name:string,uri:string>,content:string,link:struct<_href:string>,published:string,updated:string>>"


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feeds (id, body: Atom text) -> (id, feed_title, pos, kind, entry_id, title, author, link, content, at): posts t3_, comments t1_.

    What is no feed has no entries.
    """
    parsed = feeds.select("id", F.from_xml("body", ATOM, {"valueTag": "_VALUE", "mode": "PERMISSIVE"}).alias("f"))
    each = parsed.select("id", F.col("f.title").alias("feed_title"), F.posexplode(F.coalesce("f.entry", F.array().cast(ATOM.split("entry ")[1]))).alias("pos", "e"))
    kind = F.regexp_extract("e.id", "^(t[13])_", 1)
    author = F.nullif(F.trim(F.regexp_replace("e.author.name", "^/?u/", "")), F.lit(""))
    return each.select("id", "feed_title", "pos", F.nullif(kind, F.lit("")).alias("kind"), F.col("e.id").alias("entry_id"), "e.title", author.alias("author"), F.col("e.link._href").alias("link"), "e.content", F.coalesce("e.published", "e.updated").alias("at"))
