"""Streams against their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.streaming import jobs as J

START = datetime(2024, 1, 1)


def events(spark):
    rows = [(i, 1, START + timedelta(seconds=i)) for i in range(25)]
    rows += [(100 + i, 2, START + timedelta(seconds=17 * i)) for i in range(201)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_rate_limit_batch(spark):
    got = J.rate_limit_batch(events(spark)).groupBy("user_id").agg(F.count_if("accepted").alias("n")).collect()
    assert {r.user_id: r.n for r in got} == {1: 20, 2: 200}


def test_refused_requests_do_not_extend_the_window():
    verdicts, _ = J.allow([float(i) for i in range(40)] + [61.0], [])
    assert verdicts == [True] * 20 + [False] * 20 + [True]


def test_rate_limit_stream(spark, tmp_path):
    df = events(spark)
    for k in range(2):
        df.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    df.coalesce(1).write.parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/all")
    drained(J.rate_limit(stream), "limited", "update")
    got = {(r.event_id, r.accepted) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.accepted) for r in J.rate_limit_batch(df).collect()}


def test_counters_and_single_flight(spark, tmp_path):
    df = events(spark).withColumn("event_type", F.lit("view")).withColumn("key", F.col("user_id"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    drained(J.counters(stream, "10 minutes", "1 hour"), "counted", "complete")
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in J.counters(df, "10 minutes").collect()}
    drained(J.single_flight(stream), "flights")
    assert {r.key for r in spark.table("flights").collect()} == {1, 2}


def test_late_events_join_their_request(spark, tmp_path):
    requests = spark.createDataFrame([("a", START), ("b", START + timedelta(minutes=1)), ("z", START + timedelta(hours=5))], "request_id string, started timestamp")
    later = spark.createDataFrame([("a", START + timedelta(minutes=3), "completed"), ("a", START + timedelta(hours=1), "event"), ("z", START + timedelta(hours=5), "event")], "event_request string, at timestamp, kind string")
    requests.coalesce(1).write.parquet(f"{tmp_path}/r")
    later.coalesce(1).write.parquet(f"{tmp_path}/e")
    out = J.trace_stream(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/r"), spark.readStream.schema(later.schema).parquet(f"{tmp_path}/e"))
    drained(out, "traces")
    got = {(r.request_id, r.kind) for r in spark.table("traces").collect()}
    assert ("a", "completed") in got and ("a", "event") not in got


def test_replies(spark, tmp_path):
    rows = [("k", "v1", START, "old"), ("k", "v1", START + timedelta(days=1), "new"), ("x", "v0", START, "other version"), ("y", "v1", START - timedelta(days=40), "expired")]
    df = spark.createDataFrame(rows, "key string, version string, kept_at timestamp, reply string")
    now = str(START + timedelta(days=2))
    assert [r.reply for r in J.merge_replies(df.limit(0), df, "v1", now).collect()] == ["new"]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = J.reply_cache(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", "v1", f"{tmp_path}/cp", now).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.reply for r in spark.read.parquet(f"{tmp_path}/kept/0").collect()] == ["new"]


def test_forget(spark):
    rows = spark.createDataFrame([(1, ["secret", "name", "x"]), (2, ["secret"])], "id int, tokens array<string>")
    assert [r.id for r in J.forget(rows, ["secret", "name"], "tokens").collect()] == [2]


def test_single_flight_follows_chains(spark, tmp_path):
    """Requests 40 s apart under a limit of 60 s: every other one passes. A stream that sees them all at once holds the key closed."""
    rows = [("a", k, START + timedelta(seconds=40 * k)) for k in range(9)] + [("b", 100, START), ("b", 101, START + timedelta(seconds=60)), ("b", 102, START + timedelta(seconds=61)), ("c", 103, START + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    assert sorted(r.event_id for r in J.single_flight_batch(df).collect()) == [0, 2, 4, 6, 8, 100, 102, 103]
    df.write.parquet(f"{tmp_path}/in")
    drained(J.single_flight(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "chain")
    assert {r.key for r in spark.table("chain").collect()} == {"a", "b", "c"}
