"""Streams: capture, deduplicated events, lanes, job states, accumulators, debounce, sessions.

Stateful folds use ``transformWithStateInPandas`` with the RocksDB state store, which keeps the
keys' states on the executors' disks. Each has a batch form in :mod:`mnemoframe.operators.state`
with the same result over the same rows, as the tests check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from mnemoframe.functions.text import cut_bytes, event_hash, names_credential, path_excluded, redacted
from mnemoframe.operators.state import DEBOUNCE_MOST_BYTES, DEBOUNCE_SECONDS, MOST_ATTEMPTS, REFLECT_AT, STUCK_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def emitted(events: DataFrame) -> DataFrame:
    """Adds the content-addressed ``event_id`` of ``timestamp, session_id, kind, payload``."""
    return events.withColumn("event_id", event_hash("timestamp", "session_id", "kind", "payload"))


def deduplicated(events: DataFrame, at: str, horizon: str = "1 day") -> DataFrame:
    """Each event once within the horizon; a repeat that comes later passes, as state is bounded by it."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["event_id"])


def captured(observations: DataFrame, most_bytes: int = 2000) -> DataFrame:
    """Observations as they may be kept: excluded paths dropped, credentials' commands emptied, secrets redacted, texts cut. Stateless."""
    safe = F.when(names_credential("cmd"), F.lit("")).otherwise(cut_bytes(redacted("cmd"), most_bytes))
    return observations.where(~path_excluded("path")).withColumn("cmd", safe).withColumn("output", cut_bytes(redacted("output"), most_bytes)).withColumn("output_bytes", F.octet_length("output"))


def lanes(events: DataFrame, heavy: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The hot lane and the lane of heavy kinds."""
    slow = F.coalesce(F.col("kind").isin(list(heavy)), F.lit(False))
    return events.where(~slow), events.where(slow)


class _Accumulator(StatefulProcessor):
    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", StructType([StructField("total", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0.0
        pdf = pd.concat(list(rows)).sort_values("seq")
        running, trip = [], []
        for s in pdf["score"]:
            total += 0.0 if s is None or s != s else float(s)
            running.append(total)
            trip.append(total >= self.limit)
            total = 0.0 if trip[-1] else total
        self.total.update((total,))
        yield pd.DataFrame({"category": key[0], "seq": pdf["seq"].to_numpy(), "accumulated": running, "tripped": trip})

    def close(self) -> None:
        pass


def accumulating(rows: DataFrame, limit: float = REFLECT_AT) -> DataFrame:
    """``category, seq, accumulated, tripped`` of a stream ``category, seq, score``; sums go on over batches, order holds within one."""
    return rows.groupBy("category").transformWithStateInPandas(_Accumulator(limit), "category string, seq long, accumulated double, tripped boolean", "Append", "None")


class _Debounce(StatefulProcessor):
    def __init__(self, seconds: float, expire: bool) -> None:
        self.seconds, self.expire = seconds, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.seconds * 10_000) if self.expire else None
        self.last = handle.getValueState("last", StructType([StructField("last", DoubleType())]), ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["at", "id"])
        keep = []
        for t in pdf["at"]:
            keep.append(last is None or t - last >= self.seconds)
            last = float(t) if keep[-1] else last
        if last is not None:
            self.last.update((last,))
        yield pdf[keep][["content", "at", "id"]]

    def close(self) -> None:
        pass


def debouncing(rows: DataFrame, seconds: float = DEBOUNCE_SECONDS, expire: bool = True) -> DataFrame:
    """``content, at, id`` of a stream ``content string, at double, id long`` that are let through.

    Contents that don't come again are forgotten after ten times the period. That needs processing
    time, with which a query that is triggered once for what is available doesn't end: such a
    query takes ``expire=False``.
    """
    mode = "ProcessingTime" if expire else "None"
    return rows.groupBy("content").transformWithStateInPandas(_Debounce(seconds, expire), "content string, at double, id long", "Append", mode)


def small_enough(events: DataFrame, payload: str = "payload", most_bytes: int = DEBOUNCE_MOST_BYTES) -> DataFrame:
    return events.where(F.octet_length(payload) <= most_bytes)


_JOB = StructType([StructField("status", StringType()), StructField("attempts", IntegerType()), StructField("at", LongType())])


class _Jobs(StatefulProcessor):
    """Changes ``seq, action, at`` of a job: enqueue, start, succeed, fail, missing, tick."""

    def __init__(self, most: int, stuck: int) -> None:
        self.most, self.stuck = most, stuck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", _JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, since = self.job.get() if self.job.exists() else (None, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            status, attempts, since = job_step(status, attempts, since, r.action, int(r.at), self.most, self.stuck)
            out.append((key[0], int(r.seq), status, attempts))
        self.job.update((status, attempts, since))
        yield pd.DataFrame(out, columns=["event_id", "seq", "status", "attempts"])

    def close(self) -> None:
        pass


def job_step(status: str | None, attempts: int, since: int, action: str, at: int, most: int = MOST_ATTEMPTS, stuck: int = STUCK_SECONDS) -> tuple[str | None, int, int]:
    """One change of a job: (status, attempts, since when). What doesn't fit the status changes nothing."""
    if action == "enqueue" and status is None:
        return "pending", 0, at
    if action == "missing" and status in ("pending", "processing"):
        return "dead", attempts, at
    if action == "start" and status == "pending":
        return "processing", attempts, at
    if action == "succeed" and status == "processing":
        return "done", attempts + 1, at
    if action == "fail" and status == "processing":
        return ("dead" if attempts + 1 >= most else "pending"), attempts + 1, at
    if action == "tick" and status == "processing" and at - since > stuck:
        return "pending", attempts, at
    return status, attempts, since


def job_states(changes: DataFrame, most: int = MOST_ATTEMPTS, stuck: int = STUCK_SECONDS) -> DataFrame:
    """``event_id, seq, status, attempts`` after each change of a stream ``event_id, seq, action, at``."""
    return changes.groupBy("event_id").transformWithStateInPandas(_Jobs(most, stuck), "event_id string, seq long, status string, attempts int", "Append", "None")


_SESSION = StructType([StructField("status", StringType()), StructField("started", LongType()), StructField("last", LongType()), StructField("n", LongType())])


class _Sessions(StatefulProcessor):
    """Rows ``at, action``: start, prompt, end. A session idle for longer is abandoned when its next row comes, and resumes."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", _SESSION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, started, last, n = self.session.get() if self.session.exists() else (None, 0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = int(r.at)
            if status is None:
                started = at
            elif status == "active" and at - last > self.idle:
                out.append((key[0], last, "abandoned", n))
            status, last, n = ("ended" if r.action == "end" else "active"), at, n + (r.action == "prompt")
            out.append((key[0], at, status, n))
        self.session.update((status, started, last, n))
        yield pd.DataFrame(out, columns=["session_id", "at", "status", "prompts"])

    def close(self) -> None:
        pass


def session_states(rows: DataFrame, idle_seconds: int = 24 * 3600) -> DataFrame:
    """``session_id, at, status, prompts`` of a stream ``session_id, at, seq, action``."""
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(idle_seconds), "session_id string, at long, status string, prompts long", "Append", "None")


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``key, start, n`` per tumbling window; rows later than the watermark don't count."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("start"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, writes it to a parquet table and reads that."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
