"""Structured Streaming jobs over request traces, visitors and replies, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests allowed in a number of seconds.
LIMITS = ((20, 60), (200, 3600))
REPLY_DAYS, REPLIES = 30, 5_000


def trace_stream(requests: DataFrame, events: DataFrame, within: str = "10 minutes", late: str = "15 minutes") -> DataFrame:
    """Requests (request_id, started) with each event (event_request, at, kind) that comes within the time after their start; without any, once the watermark has passed."""
    left, right = requests.withWatermark("started", late), events.withWatermark("at", late)
    on = (F.col("request_id") == F.col("event_request")) & (F.col("at") >= F.col("started")) & (F.col("at") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    return left.join(right, on, "left_outer")


def allow(times: list[float], accepted: list[float]) -> tuple[list[bool], list[float]]:
    """Which requests, in order of time, stay under all limits, and the accepted times still in sight; a refused request is not counted."""
    verdicts, longest = [], max(s for _, s in LIMITS)
    for t in times:
        accepted = [a for a in accepted if a > t - longest]
        ok = all(sum(a > t - seconds for a in accepted) < most for most, seconds in LIMITS)
        verdicts.append(ok)
        if ok:
            accepted.append(t)
    return verdicts, accepted


def rate_limit(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, ts, accepted) for a stream of (user_id, event_id, ts): exact sliding limits per visitor, at most 200 times of state each."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        held = list(state.get[0]) if state.exists else []
        verdicts, held = allow([t.timestamp() for t in rows["ts"]], held)
        state.update((held,))
        state.setTimeoutDuration(max(s for _, s in LIMITS) * 1000)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "accepted": verdicts})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, accepted boolean", "accepted array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limit_batch(events: DataFrame) -> DataFrame:
    """The same verdicts for a whole table.

    A visitor's events are cut where the longest limit passes without any, since no accepted time is in sight
    there: each stretch is decided alone, and a visitor of many days is no one task's. Stretches too short
    to reach any limit pass without Python.
    """
    longest = max(s for _, s in LIMITS)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")) >= longest * 1_000_000
    cut = events.select("user_id", "event_id", "ts").withColumn("cut", F.coalesce(gap, F.lit(True)).cast("long"))
    stretches = cut.withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        verdicts, _ = allow([t.replace(tzinfo=timezone.utc).timestamp() if isinstance(t, datetime) else t for t in rows["ts"]], [])
        return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "accepted": verdicts})

    counted = stretches.withColumn("n", F.count("*").over(Window.partitionBy("user_id", "stretch")))
    fewest = min(most for most, _ in LIMITS)
    quiet = counted.filter(F.col("n") <= fewest).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("accepted"))
    busy = counted.filter(F.col("n") > fewest).select("user_id", "stretch", "event_id", "ts")
    return quiet.unionByName(busy.groupBy("user_id", "stretch").applyInPandas(step, "user_id long, event_id long, ts timestamp, accepted boolean"))


def merge_replies(kept: DataFrame, new: DataFrame, version: str, now: str | None, days: int = REPLY_DAYS, most: int = REPLIES) -> DataFrame:
    """(key, version, kept_at, reply): the last reply of each key, of this version, young enough at `now` (the present if not given), the newest `most` of all."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("kept_at").desc(), "reply"))
    fresh = kept.unionByName(new).withColumn("k", last).filter((F.col("k") == 1) & (F.col("version") == version) & (F.col("kept_at") > at - F.expr(f"INTERVAL {days} DAYS"))).drop("k")
    return fresh.orderBy(F.col("kept_at").desc(), "key").limit(most)


def reply_cache(stream: DataFrame, path: str, version: str, checkpoint: str, now: str | None = None):
    """A query that folds each micro-batch of replies into the table at `path`, a folder a batch, of which the last two stay.

    Replies expire by the time at which a batch is folded; `now` fixes it, for replays.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/{n - 1}") if n else batch.limit(0)
        merge_replies(old, batch, version, now).write.mode("overwrite").parquet(f"{path}/{n}")
        if n > 1:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n - 2}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def single_flight(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """The first request of each key (key, ts) while it is in flight.

    A stream closes a key until its watermark has passed the first request by `late`, and a watermark trails the latest
    event by `late` as well; so it lets a later request of a chain pass up to twice as late as single_flight_batch().
    """
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def single_flight_batch(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests that come more than `seconds` after the last one of their key that was let pass.

    A request so long after the one before it always passes, so each stretch without such a pause is gone through by itself.
    """
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    apart = lambda a, b: F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")) > seconds * 1_000_000
    cut = requests.withColumn("_cut", F.coalesce(apart(F.col("ts"), F.lag("ts").over(order)), F.lit(True)).cast("long"))
    stretched = cut.withColumn("_stretch", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    listed = stretched.groupBy("key", "_stretch").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("x"))

    def step(acc, r):
        passes = acc["last"].isNull() | apart(r["ts"], acc["last"])
        return F.struct(F.when(passes, r["ts"]).otherwise(acc["last"]).alias("last"), F.when(passes, F.concat(acc["out"], F.array(r["event_id"]))).otherwise(acc["out"]).alias("out"))

    kinds = dict(requests.dtypes)
    start = F.struct(F.lit(None).cast(kinds["ts"]).alias("last"), F.array().cast(f"array<{kinds['event_id']}>").alias("out"))
    kept = listed.select("key", F.explode(F.aggregate("x", start, step)["out"]).alias("event_id"))
    return requests.join(kept, ["key", "event_id"], "left_semi")


def counters(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(event_type, start, n) in tumbling windows; with a watermark on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def forget(replies: DataFrame, words: list[str], tokens: str) -> DataFrame:
    """The replies whose question lacks one of the words; those that hold all are gone."""
    return replies.filter(F.size(F.array_except(F.array(*map(F.lit, words)), F.col(tokens))) > 0)
