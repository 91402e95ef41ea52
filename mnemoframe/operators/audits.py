"""Structural audits, health scores and invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.scores import DAY, is_expired

# Penalties that results depend on.
PENALTIES = {"missing": 10, "expired": 5, "duplicates": 3, "untyped": 2, "unindexed": 1}
PENALTY_CAP = 30
AUDIT_STALE_DAYS = 60


def two_way_orphans(left: DataFrame, right: DataFrame, left_only: str = "missing", right_only: str = "unindexed") -> DataFrame:
    """``issue, key``: keys on one side only."""
    a, b = left.select("key").where("key IS NOT NULL").distinct(), right.select("key").where("key IS NOT NULL").distinct()
    one = a.join(b, "key", "left_anti").select(F.lit(left_only).alias("issue"), "key")
    return one.unionByName(b.join(a, "key", "left_anti").select(F.lit(right_only).alias("issue"), "key"))


def file_issues(files: DataFrame, stats: DataFrame, now: int) -> DataFrame:
    """``issue, key``: expired, stale, untyped and undescribed files; a file may have several issues.

    ``files`` has ``file, type, description, expires, mtime``, ``stats`` comes from the access log.
    """
    rows = files.join(stats.select("file", "d30"), "file", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    age = F.floor((now - F.col("mtime")) / DAY)
    flags = [
        ("expired", is_expired("expires", now)),
        ("stale", (age > AUDIT_STALE_DAYS) & (F.coalesce("d30", F.lit(0)) == 0)),
        ("untyped", blank("type")),
        ("no_description", blank("description")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("issue"), F.col("file").alias("key"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


def health_score(counts: DataFrame) -> DataFrame:
    """``penalty, score``: 100 less the capped penalties of each kind of issue, at least 0."""
    weight = F.lit(0)
    for name, points in PENALTIES.items():
        weight = F.when(F.col("issue") == name, points).otherwise(weight)
    row = counts.agg(F.coalesce(F.sum(F.least(F.col("n") * weight, F.lit(PENALTY_CAP))), F.lit(0)).cast("long").alias("penalty"))
    return row.withColumn("score", F.greatest(F.lit(0), 100 - F.col("penalty")).cast("long"))


def invariants(checks: Sequence[tuple[str, DataFrame, Column, float]]) -> DataFrame:
    """``check, value, most, ok`` for (name, table, aggregate, greatest value); a null aggregate counts as 0."""
    out = None
    for name, table, value, most in checks:
        row = table.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(F.lit(name).alias("check"), "value", F.lit(float(most)).alias("most"), (F.col("value") <= most).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def incomplete(files: DataFrame, required: Sequence[str], key: str = "file") -> DataFrame:
    """``key, lacking``: files that lack any of the required fields, with their names in order."""
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return files.select(F.col(key).alias("key"), F.array_join(lacking, ",").alias("lacking")).where("lacking <> ''")


def top_hubs(refs: DataFrame, k: int = 8) -> DataFrame:
    """``file, incoming``: the files that most others refer to."""
    return refs.select("from_file", "to_file").distinct().groupBy(F.col("to_file").alias("file")).agg(F.count("*").alias("incoming")).orderBy(F.desc("incoming"), "file").limit(k)
