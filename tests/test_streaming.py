"""A stream in three parts gives what its batch twin gives."""

import pytest
from pyspark.sql import functions as F

from siftpage.operators import log
from siftpage.streaming import jobs, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stream')}/events"
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = e.agg(F.min("event_id"), F.max("event_id")).first()
    third = (cut[1] - cut[0]) // 3 + 1
    for k in range(3):
        e.where(F.floor((F.col("event_id") - cut[0]) / third) == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return e, stream


def run(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def same(a, b):
    cols = sorted(a.columns)
    return sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_windows(spark, events):
    batch, stream = events
    pick = lambda df: df.select("event_type", "started", "n", "most")
    assert same(pick(run(spark, jobs.latency_windows(stream, "1 day"), "windows", "complete")), pick(jobs.latency_windows(batch, "1 day")))


def test_verdicts(spark, events):
    kind, verdict = F.when(F.col("event_id") % 3 == 0, "gate_outcome").otherwise("tier_outcome"), F.when(F.col("event_id") % 5 == 0, "timeout").when(F.col("event_id") % 7 == 0, "ok").otherwise("paywall")
    obs = lambda df: df.select(F.col("user_id").alias("fetch_id"), kind.alias("kind"), verdict.alias("verdict"), F.lit(False).alias("authoritative"))
    assert same(run(spark, jobs.running_verdicts(obs(events[1])), "verdicts", "complete"), log.resolve_verdicts(obs(events[0])))


def test_failures(spark, events):
    seen = lambda df: df.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 != 0).alias("failed"))
    out = run(spark, jobs.failure_state(seen(events[1]), 3), "failures", "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("longest_run", "opened"), "seen").alias("s")).select("key", "s.longest_run", "s.opened").where("longest_run > 0")
    assert same(last, log.failure_runs(seen(events[0]), 3))


def test_first_hints(spark, events):
    once = run(spark, jobs.first_hints(events[1].select("user_id", "event_type", "ts"), ["user_id", "event_type"], "60 days"), "hints", "append")
    assert once.count() == events[0].select("user_id", "event_type").distinct().count()


def test_uptake(spark, events):
    rows = lambda df: df.select(F.col("user_id").alias("target"), "ts", F.when(F.col("event_id") % 10 == 0, F.col("event_id")).alias("id"))
    batch = rows(events[0])
    stateful.with_rocksdb(spark)
    got = run(spark, stateful.uptake(rows(by_time(spark, events)), "400 days"), "uptake", "append")
    want = log.first_visit_after(batch.where("id is not null").select("id", "target", "ts"), batch.where("id is null").select("target", "ts")).where("followed_at is not null")
    assert same(got, want.select("id", "target", F.unix_micros("ts").alias("ts"), F.unix_micros("followed_at").alias("followed_at"))) and got.count()


def state_rows(spark, df, tmp_path, name):
    """Rows that the state of a query holds after it has taken in everything, by the state reader."""
    checkpoint = str(tmp_path / name)
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name), lambda variable: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().count()


def parts(spark, tmp_path, name, schema, *batches):
    path = str(tmp_path / name)
    for b in batches:
        spark.createDataFrame(b, schema).selectExpr("*", "timestamp_micros(cast(s * 1000000 as bigint)) as ts").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_of_suggestions_ends(spark, tmp_path):
    stateful.with_rocksdb(spark)
    day = 86_400
    rows = parts(spark, tmp_path, "s", "target long, s long, id long", [(1, day, 10), (1, day + 5, 11), (2, day, 20)], [(1, day + 9, None), (3, day + 9, 30)], [(3, 40 * day, None), (9, 40 * day, None)], [(9, 80 * day, None)])
    out, held = state_rows(spark, stateful.uptake(rows, "30 days"), tmp_path, "ends")
    assert sorted((r.id, r.target) for r in out.collect()) == [(10, 1), (11, 1)]  # 30 was followed too late
    assert held("open") == 0


def test_cache_is_reused_under_conditions_and_ends(spark, tmp_path):
    stateful.with_rocksdb(spark)
    rows = parts(
        spark, tmp_path, "c", "key string, seq long, s long, ttl double, etag string",
        [("a", 1, 100, 50.0, "e1"), ("a", 2, 120, None, None), ("b", 3, 100, 10.0, None), ("b", 4, 120, None, None), ("c", 5, 100, None, None)],
        [("a", 6, 200, None, None), ("a", 7, 210, 5.0, "e2"), ("a", 8, 212, None, None)], [("a", 9, 90_000, None, None), ("d", 10, 90_000, 10.0, "x")], [("a", 11, 400_000, None, None)],
    )
    out, held = state_rows(spark, stateful.cache(rows, "1 hour", "1 minute"), tmp_path, "cached")
    got = {r.seq: (r.outcome, r.etag) for r in out.collect()}
    assert got == {2: ("hit", None), 4: ("miss", None), 5: ("miss", None), 6: ("conditional", "e1"), 8: ("hit", None), 9: ("miss", None), 11: ("miss", None)}
    assert held("row") == 0


def by_time(spark, events):
    """The events as a stream of three parts in order of time."""
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-stream-") + "/e"
    batch = events[0]
    cuts = batch.select(F.expr("percentile(unix_micros(ts), array(0.33, 0.66))")).first()[0]
    us = F.unix_micros("ts")
    for part in (us < cuts[0], (us >= cuts[0]) & (us < cuts[1]), us >= cuts[1]):
        batch.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cache(spark, events):
    from siftpage.operators import state

    rows = lambda df: df.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("at"), F.when(F.col("event_id") % 2 == 0, F.col("value") * 3600).alias("ttl"))
    b = rows(events[0])
    reads = b.where("ttl is null").select(F.col("seq").alias("id"), F.col("key").alias("url"), F.lit("").alias("variant"), "at")
    writes = b.where("ttl is not null").select(F.col("key").alias("url"), F.lit("").alias("variant"), F.col("at").alias("fetched_at"), "ttl")
    timed = by_time(spark, events).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 2 == 0, F.col("value") * 3600).alias("ttl"), F.lit(None).cast("string").alias("etag"))
    stateful.with_rocksdb(spark)
    got = run(spark, stateful.cache(timed, "400 days"), "cache", "append").select(F.col("seq").alias("id"), (F.col("outcome") == "hit").alias("hit"))
    assert same(got, state.cache_hits(reads, writes).select("id", "hit")) and got.where("hit").count()


def test_breaker(spark, events):
    rows = lambda df: df.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("at"), (F.col("value") < 90).alias("failed"))
    got = {(r.host, r.seq): r.allowed for r in run(spark, jobs.breaker_state(rows(events[1]), 3, 200.0), "breaker", "append").collect()}
    want, kept = {}, {}
    for r in sorted(rows(events[0]).collect(), key=lambda r: r.seq):
        n, until = kept.get(r.host, (0, -1.0))
        want[r.host, r.seq] = r.at >= until
        if r.at >= until:
            n = n + 1 if r.failed else 0
            kept[r.host] = (n, r.at + 200 if n >= 3 else -1.0)
    assert got == want and not all(want.values())


def test_facts_and_open_cells(spark, events):
    from siftpage.plans.decisions import OBSERVATIONS

    assert same(jobs.running_facts(OBSERVATIONS.df(spark)), jobs.running_facts(OBSERVATIONS.df(spark).orderBy(F.rand(1))))
    said = []
    cells = lambda df: df.select(F.col("event_type").alias("system"), F.col("event_id").alias("cell"), (F.col("event_id") % 3 == 0).alias("ended"))
    q = jobs.live_summary(cells(events[1]), said.append).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.system: (r.ended, r.in_flight) for r in jobs.open_cells(cells(events[0])).collect()}
    assert said[-len(last) :] == [f"{s}: {e} done, {n} in flight" for s, (e, n) in sorted(last.items())]
