"""References to records that do not exist at the moment of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release

#: A key with more references than this is spread over several partitions of the merge.
ROWS_PER_SALT = 200_000
#: Hot keys up to which their list goes to the workers.
BROADCAST_KEYS = 100_000


def validity_intervals(parents: DataFrame, key: Column, start_us: Column, end_us: Column) -> DataFrame:
    """``key, start, end`` (end null: open) of the usable parent rows.

    A row without key or start, or whose end isn't after its start, is never valid and is left
    out. Repeated rows are one.
    """
    return parents.select(key.alias("key"), start_us.alias("start"), end_us.alias("end")).where("key IS NOT NULL AND start IS NOT NULL AND (end IS NULL OR end > start)").distinct()


def _salted(references: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: the references of each key with more than ROWS_PER_SALT are spread, its intervals repeated.

    All such keys are salted, however many; there is at most one for each ROWS_PER_SALT rows.
    """
    counts = references.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_SALT)
    hot = as_table(counts.select("key", F.ceil(F.col("n") / F.lit(ROWS_PER_SALT)).cast("int").alias("salts")), "orphan-hot")
    n = hot.count()
    if not n:
        release(hot)
        return references.withColumn("_salt", F.lit(0)), intervals.withColumn("_salt", F.lit(0))
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    salts = F.coalesce("salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[c for c in references.columns if c != "key"]), salts).cast("int")
    return (
        references.join(hot, "key", "left").withColumn("_salt", spread).drop("salts"),
        intervals.join(hot, "key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"),
    )


def reference_status(references: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``status`` to the references: ``ok``, ``missing``, ``deleted`` or ``late``.

    ``references`` has ``key string`` and ``at`` (microseconds) beside any other columns but
    ``status``. ``intervals`` comes from :func:`validity_intervals`. A reference is ok if an
    interval has start <= at < end. Else it is missing where the key has no interval at all,
    late where all its intervals start after ``at``, deleted otherwise. A null ``at`` of a known
    key is late, of another missing. References with a null key are left out.

    References and interval ends are brought together by key, sorted by time, and merged in
    one pass: a running sum of starts minus ends tells how many intervals are open. Every hot key's
    references are salted, with its intervals repeated for each salt. No partition is held as a whole.
    """
    others = [c for c in references.columns if c not in ("key", "at")]
    references = references.where("key IS NOT NULL")
    references, intervals = _salted(references, intervals)
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("_none"))
    row_type = references.select(row.alias("r")).schema["r"].dataType
    none = F.lit(None).cast(row_type)
    # An end at the time of a reference closes before it, a start opens before it. The least time marks a key that has intervals.
    edges = intervals.select(
        "key", "_salt",
        F.explode(F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")),
            F.struct(F.lit(-(1 << 63)).alias("at"), F.lit(0).alias("step")),
        )).alias("e"),
    ).where("e.at IS NOT NULL").select("key", "_salt", "e.at", F.lit(0).alias("kind"), "e.step", none.alias("row"))
    stream = references.select("key", "_salt", "at", F.lit(1).alias("kind"), F.lit(0).alias("step"), row.alias("row")).unionByName(edges)
    merge = Window.partitionBy("key", "_salt").orderBy(F.col("at").asc_nulls_last(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.select(
        "*",
        F.sum("step").over(merge).alias("open"),
        F.sum(F.greatest("step", F.lit(0))).over(merge).alias("begun"),
        F.min("kind").over(merge).alias("first"),
    ).where("kind = 1")
    status = F.when(F.col("first") == 1, "missing").when(F.col("at").isNull(), "late").when(F.col("open") > 0, "ok").when(F.col("begun") > 0, "deleted").otherwise("late")
    return merged.select("key", "at", *[F.col("row").getField(c).alias(c) for c in others], status.alias("status"))


def orphan_report(statuses: DataFrame, table: str = "ref_table", at: str = "at") -> DataFrame:
    """Counts by table, UTC month and status; the orphans' share among the period's references."""
    month = F.date_format(F.timestamp_micros(F.col(at)), "yyyy-MM")
    return (
        statuses.groupBy(F.col(table), month.alias("period"))
        .agg(
            F.count("*").alias("n_refs"),
            *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "missing", "deleted", "late")],
        )
    )
