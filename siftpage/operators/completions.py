"""Recorded completions of models, read as VARIANT: each field by its own rule, nothing raised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed vocabularies of a routed page, kinds of links, the score from which a page counts as reached.
FORMS = ["article", "thread", "listing", "reference", "tutorial", "changelog", "code", "product", "media", "other"]
SHAPES = ["prose", "records", "key-value", "code", "table", "discussion", "mixed"]
OBSTACLES = ["paywalled", "blocked", "empty", "error"]
LINK_KINDS = ["drilldown", "related", "source"]
REACHED = 3
WRAPPED = r"(?s)^\s*```[A-Za-z_]*[ \t]*\n(.*?)\n?```\s*$"
FENCED = r"(?s)```.*?(?:```|$)"
LINKS_FENCE = r"(?is)```next_links\s*\n(.*?)\n```"
OBJECT = r"(?s)\{.*\}"


def without_fences(text: Column) -> Column:
    """Prose alone: fenced blocks are taken out."""
    return F.trim(F.regexp_replace(text, FENCED, ""))


def unwrapped_json(text: Column) -> Column:
    """What a fence around the whole text holds; the text itself where there is none."""
    inner = F.regexp_extract(text, WRAPPED, 1)
    return F.when(text.rlike(WRAPPED), inner).otherwise(text)


def first_object(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(text, OBJECT, 0), F.lit(""))


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, OBJECT, ARRAY, VOID or another type's name; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column, name: str) -> Column:
    """A string that is one and not empty."""
    return F.when(kind(field(v, name)) == "STRING", F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def _integer(v: Column, name: str) -> Column:
    return F.when(kind(field(v, name)) == "BIGINT", F.try_variant_get(v, f"$.{name}", "bigint"))


def _items(v: Column, name: str) -> Column:
    """The items of a list; none for anything else."""
    return F.coalesce(F.when(kind(field(v, name)) == "ARRAY", F.try_variant_get(v, f"$.{name}", "array<variant>")), F.array().cast("array<variant>"))


def _malformed(v: Column, name: str) -> Column:
    """The field is there, is not a list, and holds something."""
    k, text = kind(field(v, name)), F.to_json(field(v, name))
    return F.coalesce(~k.isin("ARRAY", "VOID") & ~text.isin('""', "{}", "0", "false"), F.lit(False))


def routed(text: Column, provider_error: Column) -> Column:
    """struct(answer, arm, form, shape, obstacle, also_here, other_pages, axes, item_total_seen, blocked_gate, wobbles).

    Only the answer is required: without one the completion is unparsable and its prose, without fences, is the answer. A
    missing form or shape leaves the page unclassified and the index whole. Fields of a wrong type are left out; wobbles
    names them and the two that the contract asks for and that are missing.
    """
    v = F.try_parse_json(unwrapped_json(text))
    answer = _string(v, "answer")
    form, shape = _string(v, "structural_form"), _string(v, "shape")
    page = lambda x: F.struct(_integer(x, "handle").alias("handle"), F.when(_integer(x, "handle").isNull(), _string(x, "url")).alias("url"), F.coalesce(_string(x, "reason"), F.lit("")).alias("reason"), F.when(_string(x, "kind") == "structural", "structural").otherwise("drilldown").alias("kind"))
    pages = F.filter(F.transform(F.filter(_items(v, "other_pages"), lambda x: kind(x) == "OBJECT"), page), lambda p: p["handle"].isNotNull() | p["url"].isNotNull())
    also = F.transform(F.filter(_items(v, "also_here"), lambda x: (kind(x) == "STRING") & (F.try_variant_get(x, "$", "string") != "")), lambda x: F.try_variant_get(x, "$", "string"))
    axes = F.filter(F.transform(F.filter(_items(v, "refinement_axes"), lambda x: kind(x) == "OBJECT"), lambda x: F.struct(_string(x, "dimension").alias("dimension"), F.coalesce(_string(x, "how"), F.lit("")).alias("how"))), lambda a: a["dimension"].isNotNull())
    missing = [F.when(field(v, n).isNull(), F.lit(n)) for n in ("structural_form", "shape")]
    wrong = [F.when(_malformed(v, n), F.lit(n)) for n in ("also_here", "other_pages", "refinement_axes")]
    parsed = answer.isNotNull()
    arm = F.when(provider_error.isNotNull(), "provider_error").when(~parsed, "unparsable").when(form.isNull() | shape.isNull(), "unclassified").otherwise("recovered")
    only = lambda c: F.when(parsed, c)
    return F.struct(
        without_fences(F.coalesce(answer, text)).alias("answer"), arm.alias("arm"), only(form).alias("form"), only(shape).alias("shape"), only(_string(v, "obstacle")).alias("obstacle"), only(also).alias("also_here"), only(pages).alias("other_pages"),
        only(axes).alias("axes"), only(_integer(v, "item_total_seen")).alias("item_total_seen"), only(_integer(v, "blocked_gate")).alias("blocked_gate"), only(F.array_compact(F.array(*missing, *wrong))).alias("wobbles"),
    )


def violations(form: Column, shape: Column, obstacle: Column) -> Column:
    """Names of the fields whose value is outside its closed vocabulary; any of them costs the whole routing, never the answer."""
    each = [F.when(~c.isin(allowed), F.lit(n)) for n, c, allowed in (("structural_form", form, FORMS), ("shape", shape, SHAPES), ("obstacle", obstacle, OBSTACLES))]
    return F.array_compact(F.array(*each))


def _int_of(x: Column) -> Column:
    """A number cut to a whole one, a boolean or a written whole number; null for anything else."""
    s = F.try_variant_get(x, "$", "string")
    number = kind(x).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    written = (kind(x) == "STRING") & s.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("long")).when(number, F.try_variant_get(x, "$", "double").cast("long")).when(written, F.trim(s).try_cast("bigint"))


def _judged(text: Column) -> Column:
    v = F.try_parse_json(text)
    raw = _items(v, "scores")
    scores, overall, reached = F.transform(raw, _int_of), _int_of(field(v, "overall")), field(v, "reached")
    good = (kind(field(v, "scores")) == "ARRAY") & ~F.exists(scores, lambda s: s.isNull()) & overall.isNotNull()
    said = ~F.to_json(reached).isin("false", "0", '""', "null", "[]", "{}")
    why = F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit(""))
    return F.when(good, F.struct(scores.alias("scores"), overall.alias("overall"), F.when(reached.isNull(), overall >= REACHED).otherwise(said).alias("reached"), why.alias("reasoning")))


def judged(text: Column) -> Column:
    """struct(scores, overall, reached, reasoning) of a judge; null where neither the text nor the object in it can be read.

    Scores and overall must be there and be numbers; reached follows from overall where it is missing.
    """
    return F.coalesce(_judged(unwrapped_json(text)), _judged(first_object(text)))


def scored(text: Column, name: str) -> Column:
    """struct(score, reasoning) of a judge of one axis; null where it cannot be read."""

    def read(t: Column) -> Column:
        v = F.try_parse_json(t)
        score = _int_of(field(v, name))
        return F.when(score.isNotNull(), F.struct(score.alias("score"), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning")))

    return F.coalesce(read(unwrapped_json(text)), read(first_object(text)))


def split_links(text: Column) -> Column:
    """struct(answer, links) of a completion that ends in a fenced list of links; items of other kinds or types are dropped."""
    v = F.try_parse_json(F.regexp_extract(text, LINKS_FENCE, 1))
    items = F.coalesce(F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))
    plain = lambda x, n: F.when(kind(field(x, n)) == "STRING", F.try_variant_get(x, f"$.{n}", "string"))
    links = F.transform(F.filter(items, lambda x: kind(x) == "OBJECT"), lambda x: F.struct(*(plain(x, n).alias(n) for n in ("anchor", "url", "reason", "kind"))))
    links = F.filter(links, lambda x: x["anchor"].isNotNull() & x["url"].isNotNull() & x["reason"].isNotNull() & F.coalesce(x["kind"].isin(LINK_KINDS), F.lit(False)))
    fenced = text.rlike(LINKS_FENCE)
    before = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(F.regexp_extract(text, r"(?is)```next_links\s*\n.*$", 0))))
    return F.struct(F.when(fenced, before).otherwise(text).alias("answer"), F.when(fenced, links).otherwise(F.array().cast(links_type)).alias("links"))


links_type = "array<struct<anchor:string,url:string,reason:string,kind:string>>"

# What matters on pages of a kind, by the kinds for which it is not plain.
GUIDED = ["listing", "thread", "product"]
