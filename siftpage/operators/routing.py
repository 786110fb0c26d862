"""Routes, fallbacks and cookies of requests, as joins on keys rather than on predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(host: Column) -> Column:
    """The host and every parent of it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def first_route(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, host), rules (idx, pattern, proxy) -> (id, proxy) of the first rule that fits: `*`, `*.x` or exact.

    A request meets rules by the keys its host can match, so nothing is compared that does not fit. No rule: null.
    """
    host = F.lower("host")
    keys = F.concat(F.array(host, F.lit("*")), F.transform(suffixes(host), lambda s: F.concat(F.lit("*."), s)))
    met = requests.select("id", F.explode(F.array_distinct(keys)).alias("key")).join(rules.withColumn("key", F.lower("pattern")), "key")
    first = met.groupBy("id").agg(F.min_by("proxy", "idx").alias("proxy"))
    return requests.select("id").join(first, "id", "left")


def first_healthy(chains: DataFrame, healthy: DataFrame) -> DataFrame:
    """chains (id, chain), healthy (proxy) -> (id, proxy): the first of the chain that is healthy, else null."""
    each = chains.select("id", F.posexplode("chain").alias("pos", "proxy")).join(healthy.select("proxy").distinct(), "proxy")
    return chains.select("id").join(each.groupBy("id").agg(F.min_by("proxy", "pos").alias("proxy")), "id", "left")


def cookies_for(requests: DataFrame, cookies: DataFrame, now: int) -> DataFrame:
    """requests (id, host, path, secure), cookies (name, host_key, path, secure, expires) -> (id, name) of every cookie sent.

    A key fits the host itself; one with a dot in front also all below it. Its path is a prefix that ends at a boundary;
    expires 0 never ends.
    """
    host = F.col("host")
    keys = F.array_union(F.array(host), F.transform(suffixes(host), lambda s: F.concat(F.lit("."), s)))
    asked = requests.where("host <> ''").select("id", "path", "secure", F.explode(keys).alias("host_key"))
    jar = cookies.select("name", "host_key", F.col("path").alias("under"), F.col("secure").alias("only_secure"), "expires")
    under, path = F.col("under"), F.col("path")
    fits = (under == "") | (under == "/") | (path == under) | (path.startswith(under) & (under.endswith("/") | (F.substring(path, F.length(under) + 1, F.lit(1)) == "/")))
    return asked.join(jar, "host_key").where(fits & (~F.col("only_secure") | F.col("secure")) & ((F.col("expires") == 0) | (F.col("expires") > now))).select("id", "name").distinct()


def reply_parents(posts: DataFrame) -> DataFrame:
    """posts (thread, num, reply_to) -> (thread, num, parent): orphans and replies to themselves hang on the first post."""
    known = posts.select("thread", F.col("num").alias("reply_to")).distinct().withColumn("found", F.lit(True))
    first = Window.partitionBy("thread")
    own = posts.withColumn("op", F.min("num").over(first)).join(known, ["thread", "reply_to"], "left")
    return own.select("thread", "num", F.when(F.col("found") & (F.col("reply_to") != F.col("num")), F.col("reply_to")).otherwise(F.col("op")).alias("parent"))


def whole_candidates(candidates: DataFrame) -> DataFrame:
    """candidates (page, ord, body) -> (page, ord) of those that no other of the page contains; of equal ones the first.

    Bodies are compared with white space collapsed. A page has few candidates, so they meet by page.
    """
    norm = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))
    one = candidates.groupBy("page", norm.alias("norm")).agg(F.min("ord").alias("ord")).where("norm <> ''")
    other = one.select("page", F.col("norm").alias("longer"))
    return one.join(other, (one["page"] == other["page"]) & (F.length("longer") > F.length("norm")) & F.contains("longer", "norm"), "left_anti").select("page", "ord")
