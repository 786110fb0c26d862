"""Benchmark arithmetic with honest denominators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def token_f1(pairs: DataFrame) -> DataFrame:
    """pairs (slug, extracted, gold) -> (slug, n_extracted, n_gold, common, f1): bags of words, 0 without overlap."""
    bag = lambda side: pairs.select("slug", F.explode(words(F.col(side))).alias("w")).groupBy("slug", "w").agg(F.count(F.lit(1)).alias(side))
    common = bag("extracted").join(bag("gold"), ["slug", "w"]).groupBy("slug").agg(F.sum(F.least("extracted", "gold")).alias("common"))
    sizes = pairs.select("slug", F.size(words(F.col("extracted"))).alias("n_extracted"), F.size(words(F.col("gold"))).alias("n_gold"))
    out = sizes.join(common, "slug", "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    f1 = F.when(F.col("common") == 0, 0.0).otherwise(2.0 * F.col("common") / (F.col("n_extracted") + F.col("n_gold")))
    return out.withColumn("f1", F.round(f1, 9))


def summary(scores: DataFrame, by: str, value: str, threshold: float) -> DataFrame:
    """(by, n, mean, upper_median, p10, below): the median is the upper one, p10 the value at place max(0, int(0.1 n) - 1)."""
    w = Window.partitionBy(by)
    ranked = scores.select(by, value, F.row_number().over(w.orderBy(value)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    pick = lambda at: F.max(F.when(F.col("k") == at + 1, F.col(value)))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), F.round(F.avg(value), 9).alias("mean"), pick(F.expr("n div 2")).alias("upper_median"), pick(F.greatest(F.lit(0), F.expr("n div 10") - 1)).alias("p10"), F.count_if(F.col(value) < threshold).alias("below"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least 1; 0 for empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4.0).cast("int")))


class Fields:
    """UDTF: the length of every field of an envelope as JSON with a blank behind commas and colons, of texts as they are; of debug
    its own fields too, and of the whole at last."""

    def eval(self, envelope: str):
        try:
            whole = json.loads(envelope or "")
        except ValueError:
            return
        if not isinstance(whole, dict):
            return
        size = lambda v: len(v) if isinstance(v, str) else len(json.dumps(v, ensure_ascii=False))
        for key, value in whole.items():
            yield key, size(value)
            for sub, inner in value.items() if key == "debug" and isinstance(value, dict) else ():
                yield f"debug.{sub}", size(inner)
        yield "total", size(whole)


def token_breakdown(envelopes: DataFrame) -> DataFrame:
    """envelopes (id, envelope) -> (id, field, tokens): the estimate of each field and of the total; what is no object has none."""
    each = F.udtf(Fields, returnType="field string, chars int")
    rows = envelopes.select("id", "envelope").lateralJoin(each(F.col("envelope").outer()))
    tokens = F.when(F.col("chars") == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("chars") / 4.0).cast("int")))
    return rows.select("id", "field", tokens.alias("tokens"))


def wins(rows: DataFrame) -> DataFrame:
    """rows (slug, system, overall) -> (system, wins): every system at a slug's maximum wins."""
    top = rows.withColumn("place", F.rank().over(Window.partitionBy("slug").orderBy(F.desc_nulls_last("overall")))).where("place = 1 and overall is not null")
    return top.groupBy("system").agg(F.count(F.lit(1)).alias("wins"))


def coverage(rows: DataFrame) -> DataFrame:
    """rows (axis, system, disposition) -> scored, not_applicable, unscored, requested, broken, thin for each axis and system."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    out = rows.groupBy("axis", "system").agg(n("scored").alias("scored"), n("not_applicable").alias("not_applicable"), n("unscored").alias("unscored"))
    requested = F.col("scored") + F.col("unscored")
    return out.withColumns({"requested": requested, "broken": (requested >= 1) & (F.col("scored") == 0), "thin": (F.col("scored") > 0) & (F.col("scored") < 0.9 * requested)})
