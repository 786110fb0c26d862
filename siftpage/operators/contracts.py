"""What a case demands of a fetch, checked key by key: failures and keys that cannot be checked are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.functions.texts import prose_urls

# The vocabulary of demands, and those that only a replay can check.
KEYS = ("tier status has_content answer_present retrieval_incomplete narrative_present answer_contains tokens_full_max next_links_min operator_hints steps content_includes content_excludes "
        "input_menu_includes input_menu_excludes narrative_includes answer_excludes operator_hints_include operator_hints_exclude hint_severity confidence_max other_pages_min other_pages_kinds "
        "other_pages_all_have_anchor options_min options_max options_all_have_url also_here_min index_non_empty answer_urls_traceable declared_entity_type declared_fields_min declared_omitted_min").split()  # fmt: skip
REPLAY_ONLY = ["steps", "input_menu_includes", "input_menu_excludes"]
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}

OBSERVED = (
    "tier string, status string, has_content boolean, answer_present boolean, retrieval_incomplete boolean, narrative_present boolean, answer string, tokens_full bigint, next_links_count bigint, operator_hints array<string>, steps array<string>, "
    "content_md string, input_menu string, narrative string, hint_severities map<string,string>, confidence string, page_url string, other_pages array<struct<url:string,anchor:string,kind:string>>, options array<struct<title:string,url:string>>, "
    "also_here array<string>, refinement_axes array<string>, declared_type string, declared_fields map<string,string>, declared_omitted bigint"
)


def _rank(level: Column) -> Column:
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)


def failures() -> dict[str, Column]:
    """For each key how many of its demands fail, over the columns `o` (OBSERVED) and `expected` (JSON)."""
    c, e = F.col, F.col("expected")
    text, strings = F.from_json(F.concat(F.lit('{"v":'), e, F.lit("}")), "v string")["v"], F.from_json(e, "array<string>")
    number, flag = text.try_cast("bigint"), F.coalesce(text.try_cast("boolean"), F.lit(False))
    fails = lambda cond: F.coalesce(cond, F.lit(True)).cast("int")
    empty = F.array().cast("array<string>")
    said = lambda name: F.coalesce(c(f"o.{name}"), F.lit(""))
    many = lambda name: F.coalesce(F.size(c(f"o.{name}")), F.lit(0))
    count = lambda a, f: F.coalesce(F.size(F.filter(a, f)), F.lit(0))
    hints = F.coalesce("o.operator_hints", empty)
    holds = lambda name, wanted: count(strings, lambda x: F.contains(said(name), x) != F.lit(wanted))
    out = {k: fails(~c(f"o.{k}").eqNullSafe(text)) for k in ("tier", "status")}
    out |= {k: fails(F.coalesce(c(f"o.{k}"), F.lit(False)) != flag) for k in ("has_content", "answer_present", "retrieval_incomplete", "narrative_present")}
    out["answer_contains"] = fails(~F.contains(said("answer"), text))
    out["tokens_full_max"] = fails(F.coalesce("o.tokens_full", F.lit(0)) > number)
    out["next_links_min"] = fails(F.coalesce("o.next_links_count", F.lit(0)) < number)
    out |= {k: fails(~c(f"o.{k}").eqNullSafe(strings)) for k in ("operator_hints", "steps")}
    out |= {"content_includes": holds("content_md", True), "content_excludes": holds("content_md", False), "input_menu_includes": holds("input_menu", True), "input_menu_excludes": holds("input_menu", False), "narrative_includes": holds("narrative", True), "answer_excludes": holds("answer", False)}
    out["operator_hints_include"] = count(strings, lambda x: ~F.array_contains(hints, x))
    out["operator_hints_exclude"] = count(strings, lambda x: F.array_contains(hints, x))
    fired = F.coalesce("o.hint_severities", F.create_map().cast("map<string,string>"))
    out["hint_severity"] = count(F.map_entries(F.from_json(e, "map<string,string>")), lambda x: ~F.try_element_at(fired, x["key"]).eqNullSafe(x["value"]))
    out["confidence_max"] = fails(_rank(c("o.confidence")) > _rank(text))
    for name in ("other_pages", "options", "also_here"):
        out[f"{name}_min"] = fails(many(name) < number)
    out["options_max"] = fails(many("options") > number)
    out["other_pages_kinds"] = count(c("o.other_pages"), lambda r: ~F.coalesce(F.array_contains(strings, r["kind"]), F.lit(False)))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    out["other_pages_all_have_anchor"] = fails(~flag | (count(c("o.other_pages"), lambda r: blank(r["anchor"])) > 0))
    out["options_all_have_url"] = fails(~flag | (count(c("o.options"), lambda r: blank(r["url"])) > 0))
    out["index_non_empty"] = fails(((many("other_pages") + many("options") + many("also_here") + many("refinement_axes")) > 0) != flag)
    urls = lambda name: F.array_join(F.transform(F.coalesce(F.transform(f"o.{name}", lambda r: r["url"]), empty), lambda u: F.coalesce(u, F.lit(""))), " ")
    seen = F.concat_ws(" ", said("content_md"), said("page_url"), urls("other_pages"), urls("options"))
    out["answer_urls_traceable"] = F.when(flag, count(prose_urls(said("answer")), lambda u: ~F.contains(seen, u))).otherwise(1)
    out["declared_entity_type"] = fails(~c("o.declared_type").eqNullSafe(text))
    out["declared_fields_min"] = fails(many("declared_fields") < number)
    out["declared_omitted_min"] = fails(F.coalesce("o.declared_omitted", F.lit(0)) < number)
    return out


def check(demands: DataFrame, observed: DataFrame, supported: list[str] = KEYS) -> DataFrame:
    """demands (slug, key, expected as JSON) and observed (slug, observed as JSON) -> (slug, key, result, failed).

    result: passed, failed, unsupported (a key this caller cannot check) or unknown (no key at all, which counts as failed).
    """
    seen = observed.select("slug", F.from_json("observed", OBSERVED).alias("o"))
    failed = F.coalesce(*(F.when(F.col("key") == k, n) for k, n in failures().items()))
    both = demands.join(seen, "slug", "left").withColumn("failed", F.when(F.col("key").isin(*supported), failed))
    result = F.when(~F.col("key").isin(*KEYS), "unknown").when(~F.col("key").isin(*supported), "unsupported").when(F.col("failed") > 0, "failed").otherwise("passed")
    return both.select("slug", "key", result.alias("result"), F.coalesce("failed", F.lit(0)).alias("failed"))


def envelope_violations(envelope: Column, requested: Column, debug: Column) -> Column:
    """Names of the rules that an envelope (JSON text) breaks: defaults that are there, and incompleteness that is not loud."""
    v = F.try_parse_json(envelope)
    at = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    has = lambda n: F.try_variant_get(v, f"$.{n}", "variant").isNotNull()
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    incomplete = F.coalesce(F.try_variant_get(v, "$.retrieval_incomplete", "boolean"), F.lit(False))
    rules = [
        ("status_default", at("status") == "ok"), ("tier_default", at("tier") == "raw"), ("url_as_requested", at("url") == requested), ("debug_unasked", has("debug") & ~debug),
        ("next_links_no_table", has("next_links") & ~((kind("next_links") == "STRING") & (F.trim(at("next_links")) != ""))),
        ("incomplete_not_failed", incomplete & ~at("status").eqNullSafe("failed")), ("incomplete_no_narrative", incomplete & (F.trim(F.coalesce(at("narrative"), F.lit(""))) == "")),
        ("incomplete_no_hint", incomplete & (F.coalesce(F.size(F.try_variant_get(v, "$.operator_hints", "array<variant>")), F.lit(0)) == 0)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
