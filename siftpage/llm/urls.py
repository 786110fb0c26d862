"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ORDER = 4  # characters of context at most
BUCKETS = 50  # of score for one nat a character, when the threshold is set
BROADCAST_ROWS = 100_000  # a larger model is joined by shuffle, with SALTS copies of each row against frequent n-grams
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits the host or a parent of it and starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _levels(grams: DataFrame) -> DataFrame:
    """(gram, llr): log of the accepted model's probability of a gram's last character over the rejected model's.

    Witten-Bell smoothing: each context mixes its own counts with the next shorter one's estimate, by how many different
    characters have followed it; contexts that a class has never seen leave the shorter one's.
    """
    base = written(grams.groupBy("gram").agg(F.sum("acc").alias("a"), F.sum("rej").alias("r")), "url-grams")
    suffix = lambda k: F.expr(f"right(gram, {k})").alias("g")
    chars = base.groupBy(suffix(1)).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    total = chars.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("v")).first()  # one row
    n_a, n_r, v = total["a"] or 0, total["r"] or 0, total["v"]
    model = chars.select("g", ((F.col("a") + 1) / F.lit(float(n_a + v))).alias("pa"), ((F.col("r") + 1) / F.lit(float(n_r + v))).alias("pr"))
    for k in range(2, ORDER + 2):
        own = base.groupBy(suffix(k)).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("ctx", F.expr(f"left(g, {k - 1})")).withColumn("up", F.expr(f"right(g, {k - 1})"))
        ctx = own.groupBy("ctx").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        mix = lambda n, t, c, p: F.when(n + t > 0, (c + t * p) / (n + t)).otherwise(p)
        c = F.col
        model = own.join(ctx, "ctx").join(model.withColumnRenamed("g", "up"), "up").select("g", mix(c("na"), c("ta"), c("a"), c("pa")).alias("pa"), mix(c("nr"), c("tr"), c("r"), c("pr")).alias("pr"))
    return model.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("llr"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score.

    URLs that a rule decides are the labelled examples: two smoothed variable-order Markov models of characters are counted
    over all of them. score is the log-likelihood difference of host and path divided by their length; the threshold is the
    one with the least sum of both classes' error rates on the labelled URLs. A rule's verdict stands; other URLs are
    allowed from the threshold up. Without labelled URLs of both classes every other URL is allowed. Null or malformed URLs
    have empty host and path and are scored as such. Equal host and path are scored once, weighted by how often they occur.
    Repeated rows and null ids each give a row; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("u"))
    urls = written(rows.groupBy("u").agg(F.count_if(F.col("by_rule") == "allow").alias("acc"), F.count_if(F.col("by_rule") == "block").alias("rej")), "urls")
    padded = F.concat(F.lit("\u0002" * ORDER), F.col("u"), F.lit("\u0003"))
    grams = urls.select("u", "acc", "rej", F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("gram"))
    model = written(_levels(grams), "url-model")
    if model.count() <= BROADCAST_ROWS:
        hits = grams.join(F.broadcast(model), "gram")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        hits = grams.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(model.select("*", salt), ["gram", "salt"])
    scored = written(hits.groupBy("u").agg(F.round(F.avg("llr"), 9).alias("score"), F.first("acc").alias("acc"), F.first("rej").alias("rej")), "url-scores")
    bins = scored.where("acc + rej > 0").groupBy(F.floor(F.col("score") * BUCKETS).alias("bin")).agg(F.sum("acc").alias("a"), F.sum("rej").alias("r")).orderBy("bin").collect()  # as many rows as the scores' range has buckets
    accepted, rejected = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    threshold = None
    if accepted and rejected:
        below_a = below_r = 0
        best, last = (2.0, 0.0), bins[0]["bin"] - 1
        for b in bins:
            best = min(best, (below_a / accepted + 1 - below_r / rejected, (last + 1 + b["bin"]) / 2))  # midway across a gap
            below_a, below_r, last = below_a + b["a"], below_r + b["r"], b["bin"]
        threshold = best[1] / BUCKETS
    by_model = F.lit("allow") if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.join(scored.select("u", "score"), "u").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
