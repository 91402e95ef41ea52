"""Queries of the general problems: trailing totals and orphan references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions.names import common_file_name, epoch_day, epoch_second, micros_of_seconds
from mnemoframe.operators.orphans import orphan_report, reference_status, validity_intervals
from mnemoframe.operators.rolling import rolling_totals
from mnemoframe.plans.tables import table

CATALOG = Catalog()

#: The DuckDB form of a file name, for the SQL below.
_NAME = "nullif(lower(regexp_extract(trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), '[^/\\\\]*$')), '')"


def name_sql(column: str) -> str:
    return _NAME.format(column)


def usable_accesses(spark: SparkSession, folder: str) -> DataFrame:
    """``file, second, session_id, source``, each row once; without file or positive time none."""
    log = table(spark, folder, "access_log")
    return (
        log.select(common_file_name("filename").alias("file"), epoch_second("ts").alias("second"), "session_id", "source")
        .where("file IS NOT NULL AND second IS NOT NULL")
        .distinct()
    )


_ACCESSES_SQL = f"""
accesses AS (SELECT DISTINCT file, second // 86400 AS day, second, session_id, source FROM (
  SELECT {name_sql("filename")} AS file, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS second, session_id, source
  FROM access_log WHERE ts > 0) WHERE file IS NOT NULL),
daily AS (SELECT file, day, count(*) AS n FROM accesses GROUP BY ALL),
spans AS (SELECT file, min(day) AS first_day, (SELECT max(day) FROM daily) AS last_day FROM daily GROUP BY file),
days AS (SELECT file, unnest(range(first_day, last_day + 1)) AS day FROM spans),
dense AS (SELECT d.file, d.day, coalesce(n, 0) AS n FROM days d LEFT JOIN daily USING (file, day)),
totals AS (SELECT file, day, n,
  sum(n) OVER (PARTITION BY file ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n7,
  sum(n) OVER (PARTITION BY file ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n30 FROM dense)
"""


def _quiet_but_busy_before(own, sums):
    return (own == 0) & (sums[7] >= 10) & (10 * sums[7] >= 7 * sums[30])


@CATALOG.query("p1_found", f"WITH {_ACCESSES_SQL} SELECT file AS filename, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day FROM totals WHERE n = 0 AND n7 >= 10 AND 10 * n7 >= 7 * n30")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days without an access after a busy week that made most of the month."""
    accesses = usable_accesses(spark, folder)
    totals = rolling_totals(accesses, "file", epoch_day("second"), last_day=_last_day(spark, folder), every_day=False, keep=_quiet_but_busy_before)
    return totals.select(F.col("key").alias("filename"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def _last_day(spark: SparkSession, folder: str) -> int:
    log = table(spark, folder, "access_log").where(common_file_name("filename").isNotNull())
    return log.agg(F.coalesce(F.max(epoch_day(epoch_second("ts"))), F.lit(-1))).first()[0]


@CATALOG.query("p1_rolling_totals", f"WITH {_ACCESSES_SQL} SELECT file AS filename, CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS DATE) AS day, CAST(n AS BIGINT) AS n1, CAST(n7 AS BIGINT) AS n7, CAST(n30 AS BIGINT) AS n30, n7 / 7.0::DOUBLE AS avg7, n30 / 30.0::DOUBLE AS avg30 FROM totals")
def p1_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Every file and day from the file's first access to the last day of the log."""
    totals = rolling_totals(usable_accesses(spark, folder), "file", epoch_day("second"), last_day=_last_day(spark, folder))
    return totals.select(
        F.col("key").alias("filename"), "day", F.col("total").alias("n1"), F.col("total_7").alias("n7"), F.col("total_30").alias("n30"),
        (F.col("total_7") / F.lit(7.0)).alias("avg7"), (F.col("total_30") / F.lit(30.0)).alias("avg30"),
    )


#: Table, column with the reference's own key, column with the file referred to, its time in microseconds.
_REFERENCES = (
    ("refs", lambda: common_file_name("from_file"), "to_file", lambda: F.unix_micros("scanned_at")),
    ("entity_mentions", lambda: F.col("entity_id").cast("string"), "memory_filename", lambda: micros_of_seconds("ts")),
    ("co_recall", lambda: common_file_name("a"), "b", lambda: micros_of_seconds("last_fired")),
    ("memory_vectors", lambda: common_file_name("filename"), "filename", lambda: micros_of_seconds("mtime")),
)


def file_references(spark: SparkSession, folder: str) -> DataFrame:
    """``ref_table, ref_key, key, at`` of all four tables, each row once."""
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("ref_table"), ref_key().alias("ref_key"), common_file_name(to).alias("key"), at().alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
        for name, ref_key, to, at in _REFERENCES
    ]
    return reduce(DataFrame.unionByName, parts)


def _file_statuses(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "memory_files")
    intervals = validity_intervals(files, common_file_name("filename"), F.unix_micros("created_at"), F.unix_micros("deleted_at"))
    return reference_status(file_references(spark, folder), intervals)


_STATUS_SQL = f"""
r AS (
  SELECT 'refs' AS ref_table, {name_sql("from_file")} AS ref_key, {name_sql("to_file")} AS filename, epoch_us(scanned_at) AS tm FROM refs
  UNION ALL SELECT 'entity_mentions', CAST(entity_id AS VARCHAR), {name_sql("memory_filename")}, ts * 1000000 FROM entity_mentions
  UNION ALL SELECT 'co_recall', {name_sql("a")}, {name_sql("b")}, last_fired * 1000000 FROM co_recall
  UNION ALL SELECT 'memory_vectors', {name_sql("filename")}, {name_sql("filename")}, CAST(round(mtime * 1e6) AS BIGINT) FROM memory_vectors),
m AS (SELECT {name_sql("filename")} AS filename, epoch_us(created_at) AS c, epoch_us(deleted_at) AS d FROM memory_files),
v AS (SELECT DISTINCT filename, c, d FROM m WHERE filename IS NOT NULL AND c IS NOT NULL AND (d IS NULL OR d > c)),
i AS (SELECT *, row_number() OVER () AS rid FROM r WHERE filename IS NOT NULL AND tm IS NOT NULL),
s AS (SELECT rid, ref_table, ref_key, i.filename, tm,
  count(v.c) AS known, count(*) FILTER (v.c <= tm) AS begun, count(*) FILTER (v.c <= tm AND (d IS NULL OR d > tm)) AS open
  FROM i LEFT JOIN v ON i.filename = v.filename GROUP BY ALL),
st AS (SELECT ref_table, ref_key, filename, strftime(make_timestamp(tm), '%Y-%m') AS period,
  CASE WHEN open > 0 THEN 'ok' WHEN known = 0 THEN 'missing' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS status FROM s)
"""


@CATALOG.query("p3_found", f"WITH {_STATUS_SQL} SELECT DISTINCT ref_table, ref_key, filename, period FROM st WHERE status <> 'ok'")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """References whose file had no valid registry row at their time."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period")
    return _file_statuses(spark, folder).where("status <> 'ok'").select("ref_table", "ref_key", F.col("key").alias("filename"), month).distinct()


@CATALOG.query("p3_orphan_report", f"WITH {_STATUS_SQL} SELECT ref_table, period, count(*) AS n_refs, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'deleted') AS n_deleted, count(*) FILTER (status = 'late') AS n_late FROM st GROUP BY ALL")
def p3_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and month how many references are fine, missing, deleted or late."""
    return orphan_report(_file_statuses(spark, folder))
