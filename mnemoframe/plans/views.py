"""Views that bind operators to the tables, in Spark and, under the same names, in SQL.

The clock is an argument of every operator; here it stands at the end of the access log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.names import common_file_name, epoch_second
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

#: 2026-06-30 00:00:00 UTC.
NOW = 1782777600

DOCS_SQL = """docs AS (SELECT doc_id, substr(text, 1, 40) AS name, substr(text, 1, 120) AS description, text AS body, lower(trim(source)) AS type,
  CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS weight FROM documents)"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as memories: the first characters are name and description."""
    rows = table(spark, folder, "documents")
    weight = F.when(F.col("doc_id") % 4 == 0, "high").when(F.col("doc_id") % 4 == 1, "medium").when(F.col("doc_id") % 4 == 2, "low").otherwise("")
    return rows.select("doc_id", F.substring("text", 1, 40).alias("name"), F.substring("text", 1, 120).alias("description"), F.col("text").alias("body"), F.lower(F.btrim("source")).alias("type"), weight.alias("weight"))


#: A stated set of queries: a description of every fiftieth document.
ASKED_SQL = "asked AS (SELECT doc_id AS query_id, description AS query FROM docs WHERE doc_id % 50 = 0)"


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("description").alias("query"))


ACCESS_SQL = f"""acc AS (SELECT DISTINCT file, ts, session_id, source FROM (
  SELECT {name_sql("filename")} AS file, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS ts, session_id, source FROM access_log WHERE ts > 0) WHERE file IS NOT NULL)"""


def access(spark: SparkSession, folder: str) -> DataFrame:
    """``file, ts, session_id, source``: usable accesses, each once."""
    log = table(spark, folder, "access_log")
    return log.select(common_file_name("filename").alias("file"), epoch_second("ts").alias("ts"), "session_id", "source").where("file IS NOT NULL AND ts IS NOT NULL").distinct()


FILES_SQL = f"""files AS (SELECT {name_sql("filename")} AS file, max(name) AS name, max(description) AS description, max(type) AS type, max(lower(trim(weight))) AS weight,
  max(expires) AS expires, max(created) AS created, max(mtime) AS mtime FROM memory_files WHERE {name_sql("filename")} IS NOT NULL GROUP BY 1)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of the registry."""
    rows = table(spark, folder, "memory_files").withColumn("file", common_file_name("filename")).where("file IS NOT NULL")
    return rows.groupBy("file").agg(
        *[F.max(c).alias(c) for c in ("name", "description", "type")], F.max(F.lower(F.btrim("weight"))).alias("weight"), F.max("expires").alias("expires"), F.max("created").alias("created"), F.max("mtime").alias("mtime")
    )


RELATED_SQL = f"""rel AS (SELECT DISTINCT {name_sql("filename")} AS file, {name_sql("r")} AS other FROM (SELECT filename, unnest(related) AS r FROM memory_files))"""


def related(spark: SparkSession, folder: str) -> DataFrame:
    """``file, other``: related files as the registry names them."""
    rows = table(spark, folder, "memory_files").select(common_file_name("filename").alias("file"), F.explode("related").alias("r"))
    return rows.select("file", common_file_name("r").alias("other")).distinct()


#: The knowledge graph: regions, nations, suppliers and customers, with containment as edges.
NODES_SQL = """nodes AS (SELECT r_regionkey + 1 AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT n_nationkey + 101, n_name, 'nation' FROM nation
  UNION ALL SELECT s_suppkey + 1001, s_name, 'supplier' FROM supplier UNION ALL SELECT c_custkey + 10000001, c_name, 'customer' FROM customer)"""
EDGES_SQL = """edges AS (SELECT n_nationkey + 101 AS from_id, n_regionkey + 1 AS to_id, 'part_of' AS type, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT s_suppkey + 1001, s_nationkey + 101, 'located_in', 0.5 + (s_suppkey % 50) / 100.0::DOUBLE FROM supplier
  UNION ALL SELECT c_custkey + 10000001, c_nationkey + 101, 'located_in', 0.5 + (c_custkey % 50) / 100.0::DOUBLE FROM customer)"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("region", "r_regionkey", "r_name", 1), ("nation", "n_nationkey", "n_name", 101), ("supplier", "s_suppkey", "s_name", 1001), ("customer", "c_custkey", "c_name", 10000001)]
    out = None
    for name, key, label, offset in parts:
        part = table(spark, folder, name).select((F.col(key).cast("long") + offset).alias("id"), F.col(label).alias("name"), F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        ("nation", F.col("n_nationkey") + 101, F.col("n_regionkey") + 1, "part_of", F.lit(1.0)),
        ("supplier", F.col("s_suppkey") + 1001, F.col("s_nationkey") + 101, "located_in", 0.5 + (F.col("s_suppkey") % 50) / F.lit(100.0)),
        ("customer", F.col("c_custkey") + 10000001, F.col("c_nationkey") + 101, "located_in", 0.5 + (F.col("c_custkey") % 50) / F.lit(100.0)),
    ]
    out = None
    for name, src, dst, kind, confidence in parts:
        part = table(spark, folder, name).select(src.cast("long").alias("from_id"), dst.cast("long").alias("to_id"), F.lit(kind).alias("type"), confidence.alias("confidence"))
        out = part if out is None else out.unionByName(part)
    nothing = {c: F.lit(None).cast("long") for c in ("created", "valid_to", "superseded_by")}
    return out.withColumns(nothing)


#: Facts: a customer's current order priority.
FACTS_SQL = "facts AS (SELECT o_custkey AS subject, 'current_status' AS type, o_orderpriority AS object, epoch(o_orderdate)::BIGINT AS ts, o_orderkey AS seq FROM orders)"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), F.lit("current_status").alias("type"), F.col("o_orderpriority").alias("object"), at.alias("ts"), F.col("o_orderkey").alias("seq"))


#: Jobs: the user of an event is the job, the event's type its change.
JOBS_SQL = """jobs AS (SELECT user_id AS event_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS tm, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, event_type AS kind,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'dead' WHEN 'view' THEN 'processing' ELSE 'pending' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts FROM events)"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "view", "processing").otherwise("pending")
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("user_id").alias("event_id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.col("event_type").alias("kind"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"),
    )


#: The clock of the event tables: 2024-02-01 00:00:00 UTC.
EVENTS_NOW = 1706745600

#: Observations: a session is a user's day, the tool is the event's type.
OBS_SQL = """obs AS (SELECT event_id AS id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN event_type IN ('error', 'click') THEN 'shell' ELSE event_type END AS tool,
  event_type || ' ' || regexp_replace(props, '[^0-9]', '', 'g') || ' run' AS cmd, event_type = 'error' AS failed, 'f' || (event_id % 7) || '.md' AS file FROM events)"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), F.unix_timestamp("ts").alias("ts"),
        F.when(F.col("event_type").isin("error", "click"), "shell").otherwise(F.col("event_type")).alias("tool"),
        F.concat(F.col("event_type"), F.lit(" "), F.regexp_replace("props", "[^0-9]", ""), F.lit(" run")).alias("cmd"), (F.col("event_type") == "error").alias("failed"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"), F.lit(".md")).alias("file"),
    )
