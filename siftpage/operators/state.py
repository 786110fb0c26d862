"""Keyed state as batch operators: caches, health of proxies, breakers, uptake, mirrors. Streams have twins of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURES, QUARANTINE = 3, 600.0
TRIPS, OPEN_FOR = 5, 30.0


def cacheable(verdict: Column, cache_state: Column, bypass: Column, tier: Column, body: Column) -> Column:
    """Only an ok page that was fetched anew, not of an archive, not around the cache, and with a body."""
    return (verdict == "ok") & (cache_state != "hit") & ~bypass & (tier != "archive") & (F.coalesce(F.length(body), F.lit(0)) > 0)


def cache_rows(writes: DataFrame) -> DataFrame:
    """writes (url, variant, fetched_at, ttl, ..) -> each with expires_at and superseded_at, the time of the key's next write."""
    later = F.lead("fetched_at").over(Window.partitionBy("url", "variant").orderBy("fetched_at"))
    return writes.withColumn("expires_at", F.col("fetched_at") + F.col("ttl")).withColumn("superseded_at", later)


def cache_hits(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads (id, url, variant, at) -> (id, fetched_at, hit): the key's last write at that time or before, and whether it lives.

    As-of by one window over the reads and writes of a key, so reads never meet all writes.
    """
    w = writes.select("url", "variant", F.col("fetched_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(reads.schema["id"].dataType).alias("id"), F.struct("fetched_at", (F.col("fetched_at") + F.col("ttl")).alias("expires_at")).alias("row"))
    r = reads.select("url", "variant", "at", F.lit(1).alias("kind"), "id", F.lit(None).cast(w.schema["row"].dataType).alias("row"))
    before = Window.partitionBy("url", "variant").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = w.unionByName(r).withColumn("last", F.last("row", ignorenulls=True).over(before)).where("kind = 1")
    return both.select("id", F.col("last.fetched_at").alias("fetched_at"), F.coalesce(F.col("last.expires_at") > F.col("at"), F.lit(False)).alias("hit"))


def proxy_health(reports: DataFrame) -> DataFrame:
    """reports (proxy, seq, at, success) -> (proxy, seq, failures, quarantined_until) after each report.

    Failures in a row are counted since the last success; from FAILURES on each sets QUARANTINE anew, a success lifts it.
    """
    w = Window.partitionBy("proxy").orderBy("seq")
    run = reports.where("proxy <> 'direct'").withColumn("island", F.count_if(F.col("success")).over(w))
    failures = F.count_if(~F.col("success")).over(Window.partitionBy("proxy", "island").orderBy("seq"))
    run = run.withColumn("failures", F.when(F.col("success"), F.lit(0)).otherwise(failures))
    return run.select("proxy", "seq", "failures", F.when(F.col("failures") >= FAILURES, F.col("at") + QUARANTINE).otherwise(0.0).alias("quarantined_until"))


def routes(requests: DataFrame, rules: DataFrame, proxies: DataFrame) -> DataFrame:
    """requests (id, host, tier), rules (idx, host, tier, proxy, required, fallback), proxies (proxy, url) -> (id, idx, proxy, url, required).

    The first rule whose host and tier fit, each of which may be open. `direct` and unknown proxies have no URL. A request
    meets rules by the keys its host can match.
    """
    from siftpage.operators.routing import suffixes

    host = F.lower("host")
    keys = F.concat(F.array(host, F.lit("*"), F.lit("")), F.transform(suffixes(host), lambda s: F.concat(F.lit("*."), s)))
    r = rules.select("idx", F.lower(F.coalesce("host", F.lit(""))).alias("key"), F.coalesce("tier", F.lit("")).alias("rule_tier"), "proxy", "required")
    met = requests.select("id", "tier", F.explode(F.array_distinct(keys)).alias("key")).join(r, "key").where("rule_tier = '' or rule_tier = tier")
    first = met.groupBy("id").agg(F.min_by(F.struct("idx", "proxy", "required"), "idx").alias("r")).select("id", "r.*")
    known = first.join(proxies, "proxy", "left").select("id", "idx", F.when(F.col("proxy") == "direct", "direct").when(F.col("url").isNotNull(), F.col("proxy")).alias("proxy"), F.when(F.col("proxy") != "direct", F.col("url")).alias("url"), (F.col("required") & F.col("url").isNotNull() & (F.col("proxy") != "direct")).alias("required"))
    return requests.select("id").join(known, "id", "left").select("id", "idx", "proxy", "url", F.coalesce("required", F.lit(False)).alias("required"))


def mirror(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A mirror after a refresh: rows of the refreshed keys are those of fresh alone, all others stay."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def uptake_rates(followed: DataFrame, key: str) -> DataFrame:
    """(key, suggested, followed, rate) of suggestions with followed_at."""
    n = F.count("followed_at")
    return followed.groupBy(key).agg(F.count(F.lit(1)).alias("suggested"), n.alias("followed"), F.round(n / F.count(F.lit(1)), 9).alias("rate"))
