"""Queries of keyed state: latest views, upserts, folds, retention, incremental targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions.names import common_file_name
from mnemoframe.functions.text import normalised
from mnemoframe.operators import audits, graph, state
from mnemoframe.plans import views as V
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

CATALOG = Catalog()
_LATEST = f"{V.JOBS_SQL}, la AS (SELECT event_id, arg_max(seq, seq) AS seq, arg_max(tm, seq) AS tm, arg_max(updated_at, seq) AS updated_at, arg_max(kind, seq) AS kind, arg_max(status, seq) AS status, arg_max(attempts, seq) AS attempts, min(seq) AS first_pos FROM jobs GROUP BY event_id)"
_NOW = V.EVENTS_NOW


@CATALOG.query("latest_jobs", f"WITH {_LATEST} SELECT event_id, status, attempts, kind, first_pos FROM la")
def latest_jobs(spark, d):
    return state.latest_rows(V.jobs(spark, d), "event_id", "seq").select("event_id", "status", "attempts", "kind", "first_pos")


@CATALOG.query("pending_jobs", f"WITH {_LATEST} SELECT event_id, first_pos FROM la WHERE status = 'pending'")
def pending_jobs(spark, d):
    return state.read_jobs(V.jobs(spark, d), "event_id", "seq", "pending").select("event_id", "first_pos")


@CATALOG.query("job_counts", f"WITH {_LATEST} SELECT status, count(*) AS n FROM la GROUP BY status")
def job_counts(spark, d):
    return state.job_counts(V.jobs(spark, d), "event_id", "seq")


@CATALOG.query("job_compaction", f"WITH {_LATEST} SELECT event_id, status, updated_at FROM la WHERE NOT (status = 'done' AND tm < {_NOW - 7 * 86400})")
def job_compaction(spark, d):
    return state.compacted_jobs(V.jobs(spark, d), "event_id", "seq", _NOW).select("event_id", "status", "updated_at")


@CATALOG.query("reaped_jobs", f"WITH {_LATEST} SELECT event_id, CASE WHEN status = 'processing' AND tm < {_NOW - 3600} THEN 'pending' ELSE status END AS status, status = 'processing' AND tm < {_NOW - 3600} AS reaped FROM la")
def reaped_jobs(spark, d):
    return state.reaped(state.latest_rows(V.jobs(spark, d), "event_id", "seq"), _NOW, F.col("at")).select("event_id", "status", "reaped")


@CATALOG.query("drained_jobs", f"""WITH {_LATEST}, p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE kind END AS kind, attempts, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok FROM la WHERE status = 'pending'), h AS (SELECT * FROM p WHERE kind IS NULL OR kind <> 'signup')
SELECT event_id, CASE WHEN kind IS NULL THEN 'dead' WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'done' WHEN attempts + 1 >= 3 THEN 'dead' ELSE 'pending' END AS status, attempts + CASE WHEN ok IS NULL OR kind IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN kind IS NULL THEN 'event missing' WHEN NOT ok THEN 'failed' END AS last_error FROM h""")
def drained_jobs(spark, d):
    jobs = state.latest_rows(V.jobs(spark, d), "event_id", "seq").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("kind")).alias("kind"), "status", "attempts")
    outcomes = jobs.where("event_id % 3 < 2").select("event_id", (F.col("event_id") % 3 == 0).alias("ok"), F.lit("failed").alias("error"))
    return state.drained(jobs, outcomes, "event_id", skip_kinds=("signup",))


@CATALOG.query("routed_events", "SELECT event_id, CASE WHEN user_id % 2 = 0 OR event_type IN ('click', 'view') THEN 'accept' ELSE 'quarantine' END AS route FROM events")
def routed_events(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "own").alias("platform_source"))
    return state.routed(rows, ("own",), ("click", "view")).select("event_id", "route")


_HALF = "SELECT DISTINCT c_custkey % 100 AS k, c_nationkey AS v FROM customer"


@CATALOG.query("inserted_rows", "SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)")
def inserted_rows(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    base = rows.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderpriority").distinct()
    return state.inserted(base, rows.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@CATALOG.query("replaced_rows", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def replaced_rows(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return state.replaced(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@CATALOG.query("merged_rows", """WITH a AS (SELECT user_id, count(*) AS hits, min(event_type) AS first_kind, min(value) AS low FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, count(*) AS hits, max(event_type) AS first_kind, max(value) AS low FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT user_id, coalesce(a.hits, 0) + coalesce(b.hits, 0) AS hits, coalesce(a.first_kind, b.first_kind) AS first_kind, coalesce(b.low, a.low) AS low FROM a FULL JOIN b USING (user_id)""")
def merged_rows(spark, d):
    rows = table(spark, d, "events")
    a = rows.where("event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("hits"), F.min("event_type").alias("first_kind"), F.min("value").alias("low"))
    b = rows.where("event_id % 2 = 1").groupBy("user_id").agg(F.count("*").alias("hits"), F.max("event_type").alias("first_kind"), F.max("value").alias("low"))
    return state.merged(a, b, ["user_id"], keep_old=("first_kind",), add=("hits",))


_PAIR = f"least({name_sql('new_file')}, {name_sql('existing_file')}) AS x, greatest({name_sql('new_file')}, {name_sql('existing_file')}) AS y"


@CATALOG.query("open_conflicts", f"WITH c AS (SELECT {_PAIR}, CASE WHEN isnan(similarity) THEN NULL ELSE similarity END AS s FROM conflicts WHERE resolved = 0 AND {name_sql('new_file')} IS NOT NULL AND {name_sql('existing_file')} IS NOT NULL) SELECT x AS file_a, y AS file_b, max(s) AS similarity, count(*) AS n FROM c GROUP BY ALL")
def open_conflicts(spark, d):
    rows = table(spark, d, "conflicts").withColumn("new_file", common_file_name("new_file")).withColumn("existing_file", common_file_name("existing_file"))
    return state.open_conflicts(rows)


@CATALOG.query("recorded_conflicts", f"""WITH c AS (SELECT {_PAIR}, similarity AS s, resolved FROM conflicts WHERE {name_sql('new_file')} IS NOT NULL AND {name_sql('existing_file')} IS NOT NULL), o AS (SELECT DISTINCT x, y FROM c WHERE resolved = 0),
n AS (SELECT x, y, max(round_even(CASE WHEN s > 1 THEN s / 100 ELSE s END, 4)) AS similarity FROM c WHERE resolved <> 0 AND s IS NOT NULL AND NOT isnan(s) GROUP BY ALL) SELECT {V.NOW}::BIGINT AS ts, x AS new_file, y AS existing_file, similarity, 'again' AS note, 0 AS resolved FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.x = n.x AND o.y = n.y)""")
def recorded_conflicts(spark, d):
    a, b = common_file_name("new_file"), common_file_name("existing_file")
    rows = table(spark, d, "conflicts").select(F.least(a, b).alias("new_file"), F.greatest(a, b).alias("existing_file"), "similarity", "resolved", a.isNotNull().alias("x"), b.isNotNull().alias("y")).where("x AND y")
    score = F.when(F.col("similarity") > 1, F.col("similarity") / F.lit(100.0)).otherwise(F.col("similarity"))
    again = rows.where("resolved <> 0 AND similarity IS NOT NULL AND NOT isnan(similarity)").select(F.col("new_file").alias("a"), F.col("existing_file").alias("b"), score.alias("similarity"))
    return state.recorded_conflicts(rows, again, V.NOW, "again")


@CATALOG.query("changed_versions", "WITH v AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, o_orderkey FROM v WHERE p IS NULL OR p <> o_orderpriority")
def changed_versions(spark, d):
    return state.without_repeats(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority").select("o_custkey", "o_orderkey")


@CATALOG.query("pruned_versions", "SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderkey >= 10000 OR o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey)")
def pruned_versions(spark, d):
    return state.pruned_versions(table(spark, d, "orders"), "o_custkey", "o_orderkey", 10000).select("o_custkey", "o_orderkey")


@CATALOG.query("abandoned_sessions", f"WITH {V.ACCESS_SQL}, s AS (SELECT session_id, min(ts) AS started_at FROM acc WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_id, started_at, CASE WHEN started_at < {V.NOW - 86400} THEN 'abandoned' ELSE 'active' END AS status FROM s")
def abandoned_sessions(spark, d):
    rows = V.access(spark, d).where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("ts").alias("started_at")).withColumn("status", F.lit("active"))
    return state.abandoned_sessions(rows, V.NOW)


@CATALOG.query("corroborated", "WITH r AS (SELECT DISTINCT row_id, kind || '/' || predicate AS record, sources, first_seen FROM observation_corroboration), b AS (SELECT record, count(*) AS n, min(first_seen) AS first_seen, max(first_seen) AS last_seen FROM r GROUP BY record), f AS (SELECT record, sources, min(row_id) AS seq FROM r WHERE sources IS NOT NULL GROUP BY ALL), l AS (SELECT record, string_agg(sources, ',' ORDER BY seq) AS sources FROM f GROUP BY record) SELECT record, n, sources, b.first_seen, last_seen FROM b LEFT JOIN l USING (record) WHERE record IS NOT NULL")
def corroborated(spark, d):
    rows = table(spark, d, "observation_corroboration").select("row_id", "kind", "predicate", "sources", "first_seen").distinct()
    return state.corroborated(rows, F.concat("kind", F.lit("/"), "predicate"), "sources", "first_seen", "row_id")


@CATALOG.query("accumulate_reset", """WITH RECURSIVE e AS (SELECT event_type AS category, event_id AS seq, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
f AS (SELECT category, seq, n, score AS accumulated FROM e WHERE n = 1 UNION ALL SELECT e.category, e.seq, e.n, CASE WHEN f.accumulated >= 150 THEN 0 ELSE f.accumulated END + e.score FROM f JOIN e ON e.category = f.category AND e.n = f.n + 1)
SELECT category, seq, round(accumulated, 4) AS accumulated, accumulated >= 150 AS tripped FROM f""")
def accumulate_reset(spark, d):
    out = state.accumulated(table(spark, d, "events"), "event_type", "event_id", "value")
    return out.withColumn("accumulated", F.round("accumulated", 4))


@CATALOG.query("incremental_targets", f"WITH m AS (SELECT {name_sql('filename')} AS file, substr(md5(coalesce(name, '') || coalesce(description, '')), 1, 16) AS h, created_at FROM memory_files), o AS (SELECT DISTINCT file, h FROM m WHERE created_at < TIMESTAMPTZ '2026-01-01 00:00:00+00'), c AS (SELECT DISTINCT file, h FROM m) SELECT file, h FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file = c.file AND o.h = c.h)")
def incremental_targets(spark, d):
    from mnemoframe.functions.text import content_hash

    rows = table(spark, d, "memory_files").select(common_file_name("filename").alias("file"), content_hash("name", "description").alias("h"), "created_at")
    stored = rows.where(F.col("created_at") < F.lit("2026-01-01").cast("timestamp")).select("file", "h").distinct()
    return state.changed_rows(rows.select("file", "h").distinct(), stored, ["file"], "h")


@CATALOG.query("uncompressed_sessions", "SELECT DISTINCT session_id FROM access_log WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM documents WHERE session_id IS NOT NULL AND lower(trim(source)) = 'session_epilogue')")
def uncompressed_sessions(spark, d):
    done = table(spark, d, "documents").where(F.lower(F.btrim("source")) == "session_epilogue").select("session_id")
    return table(spark, d, "access_log").where("session_id IS NOT NULL").select("session_id").distinct().join(done, "session_id", "left_anti")


@CATALOG.query("mined_rows", "WITH s AS (SELECT id, source_session FROM heuristics WHERE source_session IS NOT NULL) SELECT DISTINCT session_id FROM access_log WHERE session_id IS NOT NULL AND trim(session_id) <> '' AND session_id NOT IN (SELECT source_session FROM s)")
def mined_rows(spark, d):
    mined = table(spark, d, "heuristics").where("source_session IS NOT NULL").groupBy("batch_no").agg(F.collect_set("source_session").alias("ids")).select(F.explode("ids").alias("session_id"))
    return table(spark, d, "access_log").where("session_id IS NOT NULL AND trim(session_id) <> ''").select("session_id").distinct().join(mined, "session_id", "left_anti")


@CATALOG.query("orphan_vectors", f"WITH v AS (SELECT DISTINCT {name_sql('filename')} AS key FROM memory_vectors), m AS (SELECT DISTINCT {name_sql('filename')} AS key FROM memory_files) SELECT 'missing' AS issue, key FROM v WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM m WHERE key IS NOT NULL) UNION ALL SELECT 'unindexed', key FROM m WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM v WHERE key IS NOT NULL)")
def orphan_vectors(spark, d):
    key = common_file_name("filename").alias("key")
    return audits.two_way_orphans(table(spark, d, "memory_vectors").select(key), table(spark, d, "memory_files").select(key))


@CATALOG.query("union_edges", f"SELECT {name_sql('from_file')} AS file FROM refs WHERE {name_sql('from_file')} IS NOT NULL UNION SELECT {name_sql('to_file')} FROM refs WHERE {name_sql('to_file')} IS NOT NULL")
def union_edges(spark, d):
    refs = table(spark, d, "refs")
    both = refs.select(common_file_name("from_file").alias("file")).unionByName(refs.select(common_file_name("to_file").alias("file")))
    return both.where("file IS NOT NULL").distinct()


@CATALOG.query("validity_backfill", f"WITH {V.FACTS_SQL} SELECT subject, min(ts) AS valid_from, count(*) AS n FROM facts GROUP BY subject")
def validity_backfill(spark, d):
    rows = graph.strict_fact_intervals(V.facts(spark, d))
    return rows.groupBy("subject").agg(F.min("valid_from").alias("valid_from"), F.sum("asserted").alias("n"))


@CATALOG.query("corroboration_backfill", "SELECT regexp_replace(translate(trim(lower(coalesce(subject, ''))), '\"''`‘’“”', ''), '\\s+', ' ', 'g') AS subject, count(DISTINCT row_id) AS n FROM observation_corroboration GROUP BY 1")
def corroboration_backfill(spark, d):
    return table(spark, d, "observation_corroboration").groupBy(normalised("subject").alias("subject")).agg(F.count_distinct("row_id").alias("n"))
