"""Structured Streaming forms of the timed tables: daily counters, idempotent receipts, TTL cache hits and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.sources.sinks import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive in files of the folder; a file's schema is declared, not inferred."""
    actual = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(actual).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keep: str = "all") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; each batch replaces (keep='last') or adds to the table."""
    spark = stream.sparkSession
    at = shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        # a folder for each batch, so one that is repeated after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{at}/out" if keep == "last" else f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


def daily_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, requests, errors) by event time; state of days older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.to_date("window.start").alias("day"), "requests", "errors")


def receipts(events: DataFrame) -> DataFrame:
    """The first message of each (user, kind): later ones with the same key are repeats."""
    return events.select(F.concat_ws(":", "user_id", "event_type").alias("message_key")).dropDuplicates(["message_key"])


def fresh_requests(events: DataFrame, ttl: str = "180 seconds") -> DataFrame:
    """Requests that no equal request came before within the time to live: the misses of a cache keyed by user and kind."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id", "event_type"])


class Breaker:
    """Closed, open and half-open: opens after `fails` failures in a row, tries again after `wait` seconds, closes after `good` successes."""

    def __init__(self, fails: int = 5, wait: float = 60.0, good: int = 2):
        self.fails, self.wait, self.good = fails, wait, good

    def step(self, state: tuple, now: float, ok: bool) -> tuple[tuple, bool]:
        """State (name, failures, successes, opened at) after one call, and whether the call was let through."""
        name, failed, good, opened = state
        if name == "open":
            if now - opened < self.wait:
                return state, False
            name, good = "half_open", 0
        if ok:
            if name == "half_open":
                good += 1
                return (("closed", 0, 0, 0.0) if good >= self.good else (name, failed, good, opened)), True
            return ("closed", 0, 0, 0.0), True
        failed += 1
        if name == "half_open" or failed >= self.fails:
            return ("open", failed, 0, now), True
        return (name, failed, 0, opened), True


def breaker_stream(attempts: DataFrame, rule: Breaker = Breaker()) -> DataFrame:
    """attempts (engine, at, attempt_id, ok) -> (engine, allowed, rejected, state) after each batch; four values of state per engine."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0, 0.0, 0, 0)
        s, allowed, rejected = now[:4], now[4], now[5]
        rows = pd.concat(list(batches)).sort_values(["at", "attempt_id"])
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            s, passed = rule.step(s, at.timestamp(), bool(ok))
            allowed, rejected = allowed + passed, rejected + (not passed)
        state.update((*s, allowed, rejected))
        yield pd.DataFrame({"engine": [key[0]], "allowed": [allowed], "rejected": [rejected], "state": [s[0]]})

    return attempts.groupBy("engine").applyInPandasWithState(run, "engine bigint, allowed bigint, rejected bigint, state string", "state string, failed int, good int, opened double, allowed bigint, rejected bigint", "update", GroupStateTimeout.NoTimeout)


def breaker_batch(attempts: DataFrame, rule: Breaker = Breaker()) -> DataFrame:
    """The same over a table: a fold in order of time within each engine, without texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, allowed = ("closed", 0, 0, 0.0), 0
        rows = pdf.sort_values(["at", "attempt_id"])
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            s, passed = rule.step(s, at.timestamp(), bool(ok))
            allowed += passed
        return pd.DataFrame({"engine": [pdf["engine"].iloc[0]], "allowed": [allowed], "rejected": [len(rows) - allowed], "state": [s[0]]})

    return attempts.select("engine", "at", "attempt_id", "ok").groupBy("engine").applyInPandas(run, "engine bigint, allowed bigint, rejected bigint, state string")


def token_bucket(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """requests (engine, at) -> with wait: seconds until a bucket of burst tokens, refilled at rate, lets each through.

    A token is free one refill after the later of the token before and the time at which the bucket was full, so the k-th request
    waits until the running maximum of (at of j) - j refills, plus k + 1 - burst refills: a window, in whole microseconds.
    """
    refill = round(1_000_000 / rate)
    order = Window.partitionBy("engine").orderBy("at")
    rows = requests.select("engine", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.row_number().over(order).cast("bigint").alias("k"))
    full = F.max(F.col("us") - F.col("k") * refill).over(order.rowsBetween(Window.unboundedPreceding, 0))
    wait = F.greatest(full + (F.col("k") + 1 - burst) * refill - F.col("us"), F.lit(0))
    return rows.select("engine", "at", (wait / 1_000_000).alias("wait"))
