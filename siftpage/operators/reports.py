"""Evaluation reports: axes with their denominators, costs, findings, and the rows they are written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JUDGED = ["quality", "clarity", "next_links"]
FLOOR, FIRST = 0.9, 20


def axes(rows: DataFrame, baseline: str) -> DataFrame:
    """Per system the mean of each axis beside the number of cells it is over, and the differences from the declared baseline.

    Cells without tokens and without a score do not count; conformant is a count and its denominator.
    """
    filled = lambda n: F.when(F.col(n) > 0, F.col(n)) if n == "tokens" else F.col(n)
    each = [a for n in ("quality", "tokens", "clarity", "next_links") for a in (F.round(F.avg(filled(n)), 9).alias(n), F.count(filled(n)).alias(f"{n}_n"))]
    found = rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), *each, F.count_if(F.col("conformant")).alias("conformant"), F.count("conformant").alias("conformant_n"))
    base = found.where(F.col("system") == baseline).select(*(F.col(n).alias(f"base_{n}") for n in ("quality", "tokens", "clarity")))
    both = found.join(F.broadcast(base), how="left")  # one row, if any
    other = F.col("system") != baseline
    return both.select(*found.columns, *(F.when(other, F.round(F.col(n) - F.col(f"base_{n}"), 9)).alias(f"{n}_delta") for n in ("quality", "tokens", "clarity")))


def dispositions(rows: DataFrame, names: list[str] = JUDGED) -> DataFrame:
    """(axis, system, disposition, reason), a row for each cell and judged axis."""
    cells = F.array(*(F.struct(F.lit(n).alias("axis"), F.col(f"{n}_disposition").alias("disposition"), F.col(f"{n}_reason").alias("reason")) for n in names))
    return rows.select("system", F.explode(cells).alias("c")).select("c.axis", "system", "c.disposition", "c.reason")


def coverage(cells: DataFrame) -> DataFrame:
    """(axis, system, scored, not_applicable, unscored, requested, thin), and for each axis a row of all systems with broken."""
    count = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    g = cells.groupingSets([[F.col("axis"), F.col("system")], [F.col("axis")]], "axis", "system").agg(F.grouping("system").alias("every"), count("scored"), count("not_applicable"), count("unscored"))
    requested = F.col("scored") + F.col("unscored")
    thin = (F.col("every") == 0) & (F.col("scored") > 0) & (F.col("scored") < FLOOR * requested)
    return g.select("axis", "system", "scored", "not_applicable", "unscored", requested.alias("requested"), thin.alias("thin"), ((F.col("every") == 1) & (requested > 0) & (F.col("scored") == 0)).alias("broken"))


def costs(rows: DataFrame) -> DataFrame:
    """Per system and for all (system null): what fetching and judging cost, the mean score, and the cost of a point of it."""
    g = rows.rollup("system").agg(F.count(F.lit(1)).alias("n"), F.sum("fetch_cost").alias("fetched"), F.sum("judge_cost").alias("judged"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean"))
    total = F.col("fetched") + F.col("judged")
    return g.select("system", "n", "fetched", "judged", total.alias("total"), F.round("mean", 9).alias("mean"), F.when(F.col("mean") > 0, F.round(total / F.col("mean"), 9)).alias("per_point"))


def first_errors(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """(kind, place, slug, system, reason, total): the first errors of fetching and of judging, and how many there are."""
    fetch = F.when(F.col("fetch_error").isNotNull(), F.struct(F.lit("fetch").alias("kind"), F.col("fetch_error").alias("reason")))
    judge = F.when(F.col("quality_disposition") == "unscored", F.struct(F.lit("judge").alias("kind"), F.col("quality_reason").alias("reason")))
    each = rows.select("slug", "system", F.explode(F.array_compact(F.array(fetch, judge))).alias("e")).select("e.kind", "slug", "system", "e.reason")
    totals = each.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    picked = each.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("slug", "system"))).where(F.col("place") <= first)
    return picked.join(F.broadcast(totals), "kind").select("kind", "place", "slug", "system", "reason", "total")


def headline(rows: DataFrame) -> DataFrame:
    """(metric, system, value): the numbers of a run's log line, in long form."""
    g = rows.groupBy("system").agg(F.avg("quality").alias("mean_overall"), F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("mean_envelope_tokens"), F.avg("clarity").alias("mean_clarity"), F.avg("next_links").alias("mean_next_links"), (F.count_if("conformant") / F.nullif(F.count("conformant"), F.lit(0))).alias("contract_pass"), F.sum(F.col("fetch_cost") + F.col("judge_cost")).cast("double").alias("cost"))
    names = [c for c in g.columns if c != "system"]
    return g.select("system", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.col(n), 9).alias("value")) for n in names))).alias("m")).select("m.metric", "system", "m.value").where("value is not null")


def contrast(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per key the mean of a - b with its 95 % interval by the normal law, and whether that leaves out zero."""
    d = F.col(a) - F.col(b)
    g = pairs.groupBy(key).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("half"))
    low, high = F.col("mean") - F.col("half"), F.col("mean") + F.col("half")
    return g.select(key, "n", F.round("mean", 9).alias("mean"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), ((low > 0) | (high < 0)).alias("differs"))


def tsv(rows: Column) -> Column:
    """rows: array of arrays of (key, value) strings -> a table in TSV: the union of all rows' keys in order of first sight,
    one line a row, with tabs, line ends and backslashes escaped; a key that a row has not is empty."""
    keys = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda e: e["key"]))))
    esc = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    cell = lambda r, k: F.coalesce(esc(F.get(F.filter(r, lambda e: e["key"] == k), F.lit(0))["value"]), F.lit(""))
    lines = F.transform(rows, lambda r: F.array_join(F.transform(keys, lambda k: cell(r, k)), "\t"))
    return F.array_join(F.concat(F.array(F.array_join(keys, "\t")), lines), "\n")


def leaderboard(rows: DataFrame) -> DataFrame:
    """(system, class, n, reached, mean, median): each system over all cells (class null) and over each class, scored cells alone in
    the mean and the true median."""
    g = rows.groupingSets([[F.col("system")], [F.col("system"), F.col("class")]], "system", "class").agg(F.grouping("class").alias("every"), F.count(F.lit(1)).alias("n"), F.count_if("reached").alias("reached"), F.round(F.avg("quality"), 9).alias("mean"), F.median("quality").alias("median"))
    return g.select("system", F.when(F.col("every") == 0, F.coalesce("class", F.lit(""))).alias("class"), "n", "reached", "mean", "median")


def manifest(rows: DataFrame, run: dict[str, str]) -> DataFrame:
    """One row: what the run says of itself, its systems, and how many pages and cells it has."""
    g = rows.agg(F.array_sort(F.collect_set("system")).alias("systems"), F.countDistinct("slug").alias("pages"), F.count(F.lit(1)).alias("cells"))
    return g.select(*(F.lit(v).alias(k) for k, v in sorted(run.items())), "systems", "pages", "cells")


def findings(rows: DataFrame, baseline: str, run: dict[str, str]) -> str:
    """The report as text, a few lines for each system: how many pages were reached, the mean, and how it differs from the baseline."""
    each = leaderboard(rows).where("class is null").join(axes(rows, baseline).select("system", "quality_delta"), "system").orderBy(F.desc("mean"), "system").collect()  # a row a system
    number = lambda x: "—" if x is None else f"{x:.2f}"
    lines = [f"- **{r['system']}**: reached {r['reached']}/{r['n']}, mean {number(r['mean'])}, median {number(r['median'])}" + ("" if r["quality_delta"] is None else f" ({r['quality_delta']:+.2f} to {baseline})") for r in each]
    return "\n".join([f"# Findings of {run.get('name', 'a run')}", "", *lines, ""])


def write_report(rows: DataFrame, folder: str, baseline: str, run: dict[str, str] | None = None) -> None:
    """The artifacts of a run under a folder: its rows as JSON and TSV, manifest, leaderboard, axes, coverage, costs, errors, headline, findings."""
    run = run or {}
    parts = {"leaderboard": leaderboard(rows), "axes": axes(rows, baseline), "coverage": coverage(dispositions(rows)), "cost": costs(rows), "errors": first_errors(rows), "headline": headline(rows)}
    rows.write.mode("overwrite").json(f"{folder}/results.json")
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/results.tsv")
    manifest(rows, run).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")
    text = rows.sparkSession.createDataFrame([(findings(rows, baseline, run),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/findings.md")
    for name, df in parts.items():
        df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}.tsv")
