"""Queries that mine access and observation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.operators import logs
from mnemoframe.plans import views as V
from mnemoframe.plans.tables import table

CATALOG = Catalog()

_CO = f"""cg AS (SELECT session_id, ts, list_sort(list(DISTINCT file)) AS items FROM acc WHERE trim(session_id) <> '' GROUP BY ALL), ci AS (SELECT session_id, ts, unnest(items) AS f FROM cg),
cp AS (SELECT x.f AS a, y.f AS b, count(*) AS weight, sum(exp(-ln(2) * greatest(({V.NOW} - x.ts) / 86400.0::DOUBLE, 0) / 45)) AS decayed, max(x.ts) AS last_fired FROM ci x JOIN ci y ON x.session_id = y.session_id AND x.ts = y.ts AND x.f < y.f GROUP BY ALL),
co AS (SELECT * FROM cp WHERE decayed >= 0.05)"""


def _co_recall(spark, d):
    return logs.co_recall(V.access(spark, d).where("trim(session_id) <> ''"), V.NOW, ["session_id", "ts"])


@CATALOG.query("co_recall_edges", f"WITH {V.ACCESS_SQL}, {_CO} SELECT a, b, weight, round(round_even(decayed, 6), 3) AS decayed, last_fired FROM co")
def co_recall_edges(spark, d):
    return _co_recall(spark, d).withColumn("decayed", F.round("decayed", 3))


@CATALOG.query("co_recall_partners", f"WITH {V.ACCESS_SQL}, {_CO}, s AS (SELECT a AS file, b AS partner, round(decayed, 6) AS decayed FROM co UNION ALL SELECT b, a, round(decayed, 6) FROM co) SELECT file, partner, row_number() OVER (PARTITION BY file ORDER BY decayed DESC, partner) AS rank FROM s QUALIFY rank <= 8")
def co_recall_partners(spark, d):
    return logs.strongest_partners(_co_recall(spark, d).withColumn("decayed", F.round("decayed", 6))).drop("decayed")


_GAP = """gt AS (SELECT DISTINCT ts FROM acc), gl AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > 600 OR lag(ts) OVER (ORDER BY ts) IS NULL THEN ts END AS start FROM gt),
gw AS (SELECT ts, max(start) OVER (ORDER BY ts) AS win FROM gl)"""


@CATALOG.query("gap_windows", f"WITH {V.ACCESS_SQL}, {_GAP} SELECT win AS window_start, count(*) AS n, count(DISTINCT file) AS files, max(ts) AS last FROM acc JOIN gw USING (ts) GROUP BY win")
def gap_windows(spark, d):
    rows = logs.gap_windows(V.access(spark, d), "ts")
    return rows.groupBy(F.col("window").alias("window_start")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.max("ts").alias("last"))


@CATALOG.query("gap_windows_by_session", f"WITH {V.ACCESS_SQL}, sa AS (SELECT DISTINCT session_id, ts FROM acc WHERE session_id IS NOT NULL), gl AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w > 600 OR lag(ts) OVER w IS NULL THEN ts END AS start FROM sa WINDOW w AS (PARTITION BY session_id ORDER BY ts)), gw AS (SELECT session_id, ts, max(start) OVER (PARTITION BY session_id ORDER BY ts) AS win FROM gl) SELECT session_id, win AS window_start, count(*) AS n FROM gw GROUP BY ALL")
def gap_windows_by_session(spark, d):
    rows = V.access(spark, d).where("session_id IS NOT NULL").select("session_id", "ts").distinct()
    return logs.gap_windows(rows, "ts", by=["session_id"]).groupBy("session_id", F.col("window").alias("window_start")).agg(F.count("*").alias("n"))


@CATALOG.query("co_access", f"WITH {V.ACCESS_SQL}, {_GAP}, gi AS (SELECT DISTINCT win, file FROM acc JOIN gw USING (ts)), gp AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM gi x JOIN gi y ON x.win = y.win AND x.file < y.file GROUP BY ALL ORDER BY n DESC, a, b LIMIT 20) SELECT * FROM gp WHERE n >= 3")
def co_access(spark, d):
    return logs.co_access(V.access(spark, d))


_TOP = "{0} AS (SELECT session_id, string_agg(v || 'x' || c, ', ' ORDER BY rank) AS {0} FROM (SELECT session_id, v, c, row_number() OVER (PARTITION BY session_id ORDER BY c DESC, v) AS rank FROM (SELECT session_id, {1} AS v, count(*) AS c FROM obs GROUP BY ALL) QUALIFY rank <= 3) GROUP BY session_id)"


@CATALOG.query("session_summary", f"WITH {V.OBS_SQL}, {_TOP.format('top_tools', 'tool')}, {_TOP.format('top_files', 'file')}, b AS (SELECT session_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM obs GROUP BY session_id) SELECT session_id AS session, started, ended, n, greatest(1, ended - started) AS seconds, top_tools, top_files FROM b JOIN top_tools USING (session_id) JOIN top_files USING (session_id)")
def session_summary(spark, d):
    return logs.session_summary(V.observations(spark, d), "session_id", "ts", "tool", "file")


@CATALOG.query("session_significance", f"WITH {V.ACCESS_SQL}, {V.FILES_SQL}, {V.OBS_SQL}, s AS (SELECT (SELECT count(*) FROM acc WHERE ts >= {V.NOW - 14400}) AS accesses, (SELECT count(DISTINCT file) FROM acc WHERE ts >= {V.NOW - 14400}) AS files, (SELECT count(*) FROM files WHERE mtime >= {V.NOW - 14400}) AS new, (SELECT count(*) FROM obs WHERE ts >= {V.NOW - 14400} AND failed) AS engine) SELECT *, accesses >= 5 OR files >= 4 OR new >= 1 OR engine >= 3 AS significant FROM s")
def session_significance(spark, d):
    return logs.significance(V.access(spark, d), V.files(spark, d).select("mtime"), V.observations(spark, d).select("ts", F.col("failed").alias("engine")), V.NOW)


@CATALOG.query("error_recoveries", f"""WITH {V.OBS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS n, list_distinct(regexp_extract_all(lower(cmd), '[a-z0-9_]+')) AS w FROM obs),
p AS (SELECT e.session_id, e.tool, e.id AS error_id, r.id AS rid, r.n - e.n AS distance FROM n e JOIN n r ON e.session_id = r.session_id AND e.tool = r.tool AND r.n > e.n AND r.n <= e.n + 20 WHERE e.failed AND NOT r.failed AND len(list_intersect(e.w, r.w)) / len(list_distinct(list_concat(e.w, r.w)))::DOUBLE >= 0.3)
SELECT session_id AS session, tool, error_id, arg_min(rid, distance) AS recovery_id, min(distance) AS distance FROM p GROUP BY ALL""")
def error_recoveries(spark, d):
    return logs.error_recoveries(V.observations(spark, d), "session_id", "ts", "id", "tool", "cmd", F.col("failed"))


@CATALOG.query("next_event", """WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_type AS name FROM events), f AS (SELECT * FROM e WHERE name = 'error'), s AS (SELECT * FROM e WHERE name IN ('purchase', 'view')),
j AS (SELECT f.tm, f.name, min(s.tm * 10 + CASE s.name WHEN 'purchase' THEN 0 ELSE 1 END) AS nx FROM f LEFT JOIN s ON (s.tm > f.tm OR (s.tm = f.tm AND s.name > f.name)) AND s.tm - f.tm <= 600 GROUP BY ALL)
SELECT j.tm AS "at", j.name, CASE WHEN nx IS NULL THEN NULL WHEN nx % 10 = 0 THEN 'purchase' ELSE 'view' END AS next_name, nx // 10 AS next_at FROM j JOIN f ON j.tm = f.tm""")
def next_event(spark, d):
    rows = table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("name"))
    return logs.next_event(rows, "at", "name", F.col("name") == "error", F.col("name").isin("purchase", "view"), within=600)


@CATALOG.query("nearest_in_time", """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_type FROM events), l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'view')
SELECT l.event_id, l.user_id, r.event_id AS right_key, abs(r.tm - l.tm) AS gap FROM l LEFT JOIN r USING (user_id) QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.tm - l.tm), r.tm, r.event_id) = 1""")
def nearest_in_time(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("tm"), "event_type")
    left = rows.where("event_type = 'error'").select("event_id", "user_id", "tm")
    return logs.nearest_in_time(left, rows.where("event_type = 'view'"), "tm", ["user_id"], "event_id").select("event_id", "user_id", "right_key", "gap")


@CATALOG.query("systematic_sample", "WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, greatest(1, (SELECT count(*) FROM events) // 300) AS step FROM events) SELECT event_id FROM n WHERE i % step = 0 OR event_type = 'signup'")
def systematic_sample(spark, d):
    return logs.systematic_sample(table(spark, d, "events"), ["ts", "event_id"], F.col("event_type") == "signup", 300).select("event_id")


_STATS = f"stats AS (SELECT file, max(ts) AS last, count(*) AS total, count(*) FILTER (ts >= {V.NOW - 30 * 86400}) AS d30 FROM acc GROUP BY file)"


@CATALOG.query("weight_suggestions", f"WITH {V.ACCESS_SQL}, {V.FILES_SQL}, r AS (SELECT file, count(*) AS n7 FROM acc WHERE ts >= {V.NOW - 7 * 86400} GROUP BY file), x AS (SELECT file, coalesce(weight, '') AS w, coalesce(n7, 0) AS n7, floor(({V.NOW} - mtime) / 86400) AS age FROM files LEFT JOIN r USING (file)) SELECT file, coalesce(nullif(w, ''), '(none)') AS current, CASE WHEN n7 >= 5 THEN 'high' ELSE 'low' END AS suggested, n7 FROM x WHERE (n7 >= 5 AND w <> 'high') OR (n7 = 0 AND w = '' AND age > 30)")
def weight_suggestions(spark, d):
    return logs.weight_suggestions(V.files(spark, d), V.access(spark, d), V.NOW)


@CATALOG.query("stale_files", f"WITH {V.ACCESS_SQL}, {V.FILES_SQL}, {_STATS}, x AS (SELECT file, coalesce(last, 0) AS last, coalesce(d30, 0) AS d30, floor(({V.NOW} - mtime) / 86400) AS age FROM files LEFT JOIN stats USING (file) WHERE coalesce(weight, '') <> 'high') SELECT file, CASE WHEN last = 0 THEN 'never' ELSE strftime(to_timestamp(last), '%Y-%m-%d') END AS last_access FROM x WHERE (last = 0 AND age > 90) OR (last > 0 AND last < {V.NOW - 90 * 86400} AND d30 = 0)")
def stale_files(spark, d):
    return logs.stale_files(V.files(spark, d), logs.access_stats(V.access(spark, d), V.NOW), V.NOW)


@CATALOG.query("hot_and_stale", f"WITH {V.ACCESS_SQL}, {V.FILES_SQL}, {_STATS} SELECT file, total, CAST(floor(({V.NOW} - coalesce(epoch(try_strptime(created, '%Y-%m-%d')), floor(mtime))) / 86400) AS BIGINT) AS age FROM files JOIN stats USING (file) WHERE total >= 20 AND floor(({V.NOW} - coalesce(epoch(try_strptime(created, '%Y-%m-%d')), floor(mtime))) / 86400) >= 45")
def hot_and_stale(spark, d):
    rows = V.files(spark, d).withColumn("event_date", F.lit(None).cast("string"))
    return logs.hot_and_stale(rows, logs.access_stats(V.access(spark, d), V.NOW), V.NOW)


@CATALOG.query("weekly_growth", "SELECT isoyear(created_at) || '-W' || lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0') AS week, type AS kind, count(*) AS n FROM memory_files WHERE created_at IS NOT NULL GROUP BY ALL")
def weekly_growth(spark, d):
    return logs.weekly_growth(table(spark, d, "memory_files"), F.col("created_at").cast("date"), F.col("type"))


@CATALOG.query("cost_rollup", f"WITH p AS (SELECT unnest(['click', 'view']) AS model, unnest([3.0, 0.5]) AS i, unnest([15.0, 2.0]) AS o) SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000) AS tokens_in, sum(event_id % 100) AS tokens_out, round(sum((event_id % 1000 * coalesce(i, 0) + event_id % 100 * coalesce(o, 0)) / 1e6), 6) AS cost FROM events LEFT JOIN p ON model = event_type WHERE epoch(ts) >= {V.EVENTS_NOW - 7 * 86400} GROUP BY event_type")
def cost_rollup(spark, d):
    calls = table(spark, d, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.5, 2.0)], "model string, price_in double, price_out double")
    return logs.cost_rollup(calls, prices, V.EVENTS_NOW, 7).withColumn("cost", F.round("cost", 6))


_WEEK = "isoyear(written_at) || '-W' || lpad(CAST(weekofyear(written_at) AS VARCHAR), 2, '0')"


@CATALOG.query("week_triage", f"WITH d AS (SELECT {_WEEK} AS week, count(*) AS n FROM documents WHERE lower(trim(source)) = 'candidate_draft' AND written_at IS NOT NULL AND {_WEEK} < '2026-W27' GROUP BY 1), g AS (SELECT DISTINCT {_WEEK} AS week FROM documents WHERE lower(trim(source)) = 'weekly_digest') SELECT week, CASE WHEN g.week IS NOT NULL THEN n ELSE 0 END AS archive, CASE WHEN g.week IS NULL THEN n ELSE 0 END AS needs_digest FROM d LEFT JOIN g USING (week)")
def week_triage(spark, d):
    from mnemoframe.functions.text import iso_week

    rows = table(spark, d, "documents").withColumn("kind", F.lower(F.btrim("source"))).withColumn("day", F.col("written_at").cast("date"))
    digests = rows.where("kind = 'weekly_digest'").select(iso_week("day").alias("week"))
    return logs.week_triage(rows.where("kind = 'candidate_draft'"), digests, F.col("day"), "2026-W27")


_KEYWORDS = ["ledger", "baseline", "quota", "orchard"]


@CATALOG.query("keyword_states", f"""WITH l AS (SELECT doc_id, lower(text) AS low, unnest({_KEYWORDS}) AS keyword FROM documents WHERE coalesce(text, '') <> ''), h AS (SELECT keyword, doc_id, substr(trim(list_filter(regexp_split_to_array(low, '\\r\\n|\\n|\\r'), lambda x: contains(x, keyword))[1]), 1, 120) AS line FROM l WHERE contains(low, keyword)),
e AS (SELECT keyword, string_agg(line, ' | ' ORDER BY doc_id) AS examples FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY doc_id) <= 3) GROUP BY keyword) SELECT keyword, count(*) AS n, any_value(examples) AS examples FROM h JOIN e USING (keyword) GROUP BY keyword""")
def keyword_states(spark, d):
    return logs.keyword_states(table(spark, d, "documents"), "text", _KEYWORDS, "doc_id")
