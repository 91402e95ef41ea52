"""Keyed state kept as append-only rows: latest views, upserts, folds, retention."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.scores import DAY

# Constants that results depend on.
MOST_ATTEMPTS, STUCK_SECONDS, KEEP_DONE_DAYS, ABANDONED_HOURS = 3, 3600, 7, 24
REFLECT_AT = 150
DEBOUNCE_SECONDS, DEBOUNCE_MOST_BYTES = 60, 4096
CACHE_LEAST_BYTES, CACHE_MOST_BYTES, CACHE_SECONDS, CACHE_CLOCK_SLACK = 2048, 16384, 24 * 3600, 0.1


def latest_rows(log: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The last row of each key with ``first_pos``, where the key came first; rows without key don't count."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in log.columns if c not in keys]
    rows = log.dropna(subset=keys)
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_r"), F.min(seq).alias("first_pos"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "first_pos")


def read_jobs(log: DataFrame, key: str, seq: str, status: str | None = None, limit: int = 0) -> DataFrame:
    """Latest job rows in the order of their first appearance; ``limit`` 0 means all."""
    rows = latest_rows(log, key, seq)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    rows = rows.orderBy("first_pos", key)
    return rows.limit(limit) if limit else rows


def job_counts(log: DataFrame, key: str, seq: str) -> DataFrame:
    return latest_rows(log, key, seq).groupBy("status").agg(F.count("*").alias("n"))


def compacted_jobs(log: DataFrame, key: str, seq: str, now: int, days: int = KEEP_DONE_DAYS, updated: str = "updated_at") -> DataFrame:
    """The latest rows, without jobs done more than so many days ago; an unusable time keeps its row."""
    at = F.unix_timestamp(F.try_to_timestamp(F.col(updated).cast("string")))
    old = (F.col("status") == "done") & (at < now - days * DAY)
    return latest_rows(log, key, seq).where(~F.coalesce(old, F.lit(False)))


def reaped(jobs: DataFrame, now: int, at: Column, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Jobs that were processing for longer are pending again; ``reaped`` tells which."""
    stuck = F.coalesce((F.col("status") == "processing") & (at < now - seconds), F.lit(False))
    return jobs.withColumn("reaped", stuck).withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def drained(jobs: DataFrame, outcomes: DataFrame, key: str, most: int = MOST_ATTEMPTS, skip_kinds: Sequence[str] = ()) -> DataFrame:
    """Pending jobs after one drain: ``key, status, attempts, last_error``.

    ``jobs`` has ``key, kind, status, attempts``; ``outcomes`` has ``key, ok boolean, error``. A
    job without kind (its event is missing) is dead at once; one without outcome stays pending;
    a failure is pending again until it has ``most`` attempts, then dead.
    """
    pending = jobs.where(F.col("status") == "pending")
    if skip_kinds:
        pending = pending.where(F.col("kind").isNull() | ~F.col("kind").isin(list(skip_kinds)))
    rows = pending.join(outcomes, key, "left")
    tried = F.col("attempts") + F.when(F.col("ok").isNull() | F.col("kind").isNull(), 0).otherwise(1)
    status = F.when(F.col("kind").isNull(), "dead").when(F.col("ok").isNull(), "pending").when(F.col("ok"), "done").when(tried >= most, "dead").otherwise("pending")
    error = F.when(F.col("kind").isNull(), F.lit("event missing")).when(~F.col("ok"), F.col("error"))
    return rows.select(key, status.alias("status"), tried.alias("attempts"), error.alias("last_error"))


def routed(events: DataFrame, trusted: Sequence[str], open_kinds: Sequence[str], source: str = "platform_source", kind: str = "kind") -> DataFrame:
    """Adds ``route``: accept, or quarantine where an untrusted or unknown source sends other than the open kinds."""
    ok = F.coalesce(F.col(source).isin(list(trusted)), F.lit(False)) | F.coalesce(F.col(kind).isin(list(open_kinds)), F.lit(False))
    return events.withColumn("route", F.when(ok, "accept").otherwise("quarantine"))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: the table and the rows whose key it lacks, the first per key by all other columns, in their order, nulls first."""
    others = [c for c in table.columns if c not in keys]
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*others) if others else F.lit(0)).alias("_r"))
    fresh = fresh.join(table.select(*keys), keys, "left_anti").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
    return table.unionByName(fresh.select(*table.columns))


def replaced(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace: per key the row with the greatest version, new rows before old on ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("_new", F.lit(1)))
    others = [c for c in table.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(version), F.col("_new"))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*table.columns)


def merged(table: DataFrame, rows: DataFrame, keys: list[str], keep_old: Sequence[str] = (), add: Sequence[str] = ()) -> DataFrame:
    """On-conflict update: new values win where they aren't null; ``keep_old`` columns only fill gaps, ``add`` columns are summed."""
    new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in keys])
    joined = table.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if f"_n_{c}" not in new.columns:
            return F.col(c)
        if c in add:
            return F.coalesce(c, F.lit(0)) + F.coalesce(f"_n_{c}", F.lit(0))
        return F.coalesce(c, f"_n_{c}") if c in keep_old else F.coalesce(f"_n_{c}", c)

    return joined.select(*keys, *[value(c).alias(c) for c in table.columns if c not in keys])


def recorded_conflicts(existing: DataFrame, pairs: DataFrame, now: int, note: str) -> DataFrame:
    """New conflict rows for pairs ``a, b, similarity`` that have no open row, ends in order, similarity to four places."""
    ordered = pairs.select(F.least("a", "b").alias("new_file"), F.greatest("a", "b").alias("existing_file"), F.bround("similarity", 4).alias("similarity"))
    ordered = ordered.groupBy("new_file", "existing_file").agg(F.max("similarity").alias("similarity"))
    open_ = existing.where("resolved = 0").select("new_file", "existing_file").distinct()
    return ordered.join(open_, ["new_file", "existing_file"], "left_anti").select(F.lit(now).cast("long").alias("ts"), "new_file", "existing_file", "similarity", F.lit(note).alias("note"), F.lit(0).alias("resolved"))


def open_conflicts(conflicts: DataFrame) -> DataFrame:
    """Open rows, one per pair in order: the greatest similarity first, NaN and null last."""
    s = F.nanvl("similarity", F.lit(None).cast("double"))
    rows = conflicts.where("resolved = 0 AND new_file IS NOT NULL AND existing_file IS NOT NULL")
    return rows.groupBy(F.least("new_file", "existing_file").alias("file_a"), F.greatest("new_file", "existing_file").alias("file_b")).agg(F.max(s).alias("similarity"), F.count("*").alias("n"))


def without_repeats(versions: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Versions whose text differs from the key's version before; empty and null texts are no versions."""
    rows = versions.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_h", F.sha2(text, 256))
    order = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("_p", F.lag("_h").over(order)).where(F.col("_p").isNull() | (F.col("_p") != F.col("_h"))).drop("_h", "_p")


def pruned_versions(versions: DataFrame, key: str, at: str, before: int) -> DataFrame:
    """Versions that stay: those not before the limit, and each key's oldest."""
    oldest = F.min(at).over(Window.partitionBy(key))
    return versions.withColumn("_o", oldest).where((F.col(at) >= before) | (F.col(at) == F.col("_o"))).drop("_o")


def abandoned_sessions(sessions: DataFrame, now: int, hours: int = ABANDONED_HOURS) -> DataFrame:
    """Sessions with ``status``: active ones that began longer ago are abandoned."""
    old = (F.col("status") == "active") & (F.col("started_at") < now - hours * 3600)
    return sessions.withColumn("status", F.when(old, "abandoned").otherwise(F.col("status")))


def corroborated(observations: DataFrame, key: Column, source: str, at: str, seq: str) -> DataFrame:
    """``record, n, sources, first_seen, last_seen``: sources once each, joined in the order they came first."""
    rows = observations.select(key.alias("record"), F.col(source).alias("source"), F.col(at).alias("at"), F.col(seq).alias("seq")).where("record IS NOT NULL")
    base = rows.groupBy("record").agg(F.count("*").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    firsts = rows.where("source IS NOT NULL").groupBy("record", "source").agg(F.min("seq").alias("seq"))
    listed = firsts.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return base.join(listed, "record", "left")


def _trips(rows: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    key, total = None, 0.0
    for pdf in rows:
        trip, running = [], []
        for k, s in zip(pdf["category"], pdf["score"]):
            if k != key:
                key, total = k, 0.0
            total += 0.0 if s is None or s != s else float(s)
            running.append(total)
            trip.append(total >= limit)
            if trip[-1]:
                total = 0.0
        out = pdf[["category", "seq"]].copy()
        out["accumulated"], out["tripped"] = running, trip
        yield out


def accumulated(rows: DataFrame, category: str, seq: str, score: str, limit: int = REFLECT_AT) -> DataFrame:
    """``category, seq, accumulated, tripped``: a running sum per category that starts anew once it reaches the limit.

    The reset makes each row depend on all before it, so this is a sequential fold, streamed
    over the sorted rows of each category; no category is held in memory.
    """
    picked = rows.select(F.col(category).cast("string").alias("category"), F.col(seq).cast("long").alias("seq"), F.col(score).cast("double").alias("score")).where("category IS NOT NULL")
    ordered = picked.repartition("category").sortWithinPartitions("category", "seq")
    return ordered.mapInPandas(lambda it: _trips(it, limit), "category string, seq long, accumulated double, tripped boolean")


def _emitted(rows: Iterator[pd.DataFrame], seconds: float) -> Iterator[pd.DataFrame]:
    key, last = None, None
    for pdf in rows:
        keep = []
        for k, t in zip(pdf["content"], pdf["at"]):
            if k != key:
                key, last = k, None
            keep.append(last is None or t - last >= seconds)
            if keep[-1]:
                last = t
        yield pdf[keep]


def debounced(events: DataFrame, content: Column, at: str, id: str, payload: Column, seconds: int = DEBOUNCE_SECONDS, most_bytes: int = DEBOUNCE_MOST_BYTES) -> DataFrame:
    """``content, at, id`` of events that are let through: not too large, and not within so many seconds after the last one let through with the same content."""
    rows = events.where(F.octet_length(payload) <= most_bytes).select(content.cast("string").alias("content"), F.col(at).cast("double").alias("at"), F.col(id).cast("long").alias("id")).where("content IS NOT NULL AND at IS NOT NULL")
    ordered = rows.repartition("content").sortWithinPartitions("content", "at", "id")
    return ordered.mapInPandas(lambda it: _emitted(it, seconds), "content string, at double, id long")


def cache_usable(size: Column, captured: Column, modified: Column, now: int) -> Column:
    """Whether a cached summary may stand for a file: sized in between, of the last day, and not older than the file."""
    return F.coalesce((size >= CACHE_LEAST_BYTES) & (size <= CACHE_MOST_BYTES) & (now - captured <= CACHE_SECONDS) & (modified <= captured + CACHE_CLOCK_SLACK), F.lit(False))


def changed_rows(current: DataFrame, stored: DataFrame, keys: list[str], hash_: str) -> DataFrame:
    """Rows whose key and hash aren't stored: what an incremental step has to compute."""
    return current.join(stored.select(*keys, hash_), [*keys, hash_], "left_anti")


def consolidation_due(last: int | None, now: int, window: int = 1800, skew: int = 60) -> bool:
    """Whether a coalesced job runs: never ran, ran in the future, or at least a window less the skew ago."""
    return last is None or last > now or now - last >= window - skew
