"""The artifacts of a run, written and read again."""

import json

from siftpage.operators import reports as R

SCHEMA = "slug string, class string, system string, quality double, reached boolean, tokens long, clarity double, next_links double, conformant boolean, fetch_cost double, judge_cost double, fetch_error string, quality_disposition string, quality_reason string, clarity_disposition string, clarity_reason string, next_links_disposition string, next_links_reason string"


def cell(slug, kind, system, quality, error=None):
    said = ("scored", None) if quality is not None else ("unscored", "no_judge")
    return (slug, kind, system, quality, (quality or 0) >= 3, 100, quality, None, None if error else True, 0.1, 0.2, error, *said, *said, "not_applicable", None)


ROWS = [cell("a", "shop", "base", 2.0), cell("b", "shop", "base", 4.0), cell("c", "news", "base", None, "timeout\tx"), cell("a", "shop", "full", 5.0), cell("b", "shop", "full", 3.0), cell("c", "news", "full", 4.0)]


def test_leaderboard_and_manifest(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["system"], r["class"]): (r["n"], r["reached"], r["mean"], r["median"]) for r in R.leaderboard(rows).collect()}
    assert got[("base", None)] == (3, 1, 3.0, 3.0) and got[("full", None)] == (3, 3, 4.0, 4.0) and got[("base", "news")] == (1, 0, None, None) and got[("full", "shop")] == (2, 2, 4.0, 4.0)
    assert R.manifest(rows, {"name": "r1"}).first().asDict() == {"name": "r1", "systems": ["base", "full"], "pages": 3, "cells": 6}
    assert R.findings(rows, "base", {"name": "r1"}) == "# Findings of r1\n\n- **full**: reached 3/3, mean 4.00, median 4.00 (+1.00 to base)\n- **base**: reached 1/3, mean 3.00, median 3.00\n"


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    R.write_report(rows, str(tmp_path), "base", {"name": "r1"})
    read = lambda name: spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/{name}.tsv")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["results.json", "results.tsv", "manifest.json", "findings.md", *(f"{n}.tsv" for n in ("leaderboard", "axes", "coverage", "cost", "errors", "headline"))])
    assert spark.read.json(f"{tmp_path}/results.json").count() == read("results").count() == 6
    part = next(p for p in (tmp_path / "manifest.json").iterdir() if p.name.startswith("part"))
    assert json.loads(part.read_text())["cells"] == 6
    errors = {(r.kind, r.slug, r.reason, r.total) for r in read("errors").collect()}
    assert errors == {("fetch", "c", "timeout\tx", "1"), ("judge", "c", "no_judge", "1")}
    assert "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/findings.md").collect()).startswith("# Findings of r1")
