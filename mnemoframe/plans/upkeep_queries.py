"""Queries of upkeep: checks before a write, marks of use, skipped sessions, expansion, habits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions.names import common_file_name
from mnemoframe.functions.text import text_hash
from mnemoframe.operators import upkeep
from mnemoframe.plans import views as V
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

CATALOG = Catalog()

_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_PLAIN = "regexp_replace(translate(trim(lower(coalesce(text, ''))), '\"''`‘’“”', ''), '\\s+', ' ', 'g')"


@CATALOG.query("write_conflicts", f"""WITH w AS (SELECT doc_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM documents WHERE doc_id % 50 = 0), dt AS (SELECT doc_id AS id, term, count(*) AS tf FROM w GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS na FROM dt GROUP BY id HAVING sum(tf) >= 20),
fw AS (SELECT doc_id, unnest({_TERMS.format("'note  ' || coalesce(text, '')")}) AS term FROM documents WHERE doc_id % 50 <> 0), ft AS (SELECT doc_id AS file, term, count(*) AS tf FROM fw GROUP BY ALL), fn AS (SELECT file, sqrt(sum(tf * tf)::DOUBLE) AS nb FROM ft GROUP BY file),
e AS (SELECT id, min(file) AS file FROM (SELECT doc_id AS id, {_PLAIN} AS t FROM documents WHERE doc_id IN (SELECT id FROM dn)) JOIN (SELECT doc_id AS file, {_PLAIN} AS t FROM documents WHERE doc_id % 50 <> 0) USING (t) GROUP BY id),
s AS (SELECT id, file, sum(dt.tf * ft.tf) / (any_value(na) * any_value(nb)) AS similarity FROM dt JOIN ft USING (term) JOIN dn USING (id) JOIN fn USING (file) WHERE id NOT IN (SELECT id FROM e) GROUP BY ALL),
k AS (SELECT id, 'similar' AS kind, file, similarity, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 10) DESC, file) AS rank FROM s WHERE round(similarity, 10) >= 0.55 QUALIFY rank <= 3)
SELECT id, kind, file, round(similarity, 6) AS similarity, rank FROM k UNION ALL SELECT id, 'exact', file, 1.0, 1 FROM e""")
def write_conflicts(spark, d):
    docs = table(spark, d, "documents")
    drafts = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("file"), F.lit("note").alias("name"), F.col("text").alias("content"))
    files = docs.where("doc_id % 50 <> 0").select(F.col("doc_id").alias("file"), F.lit("note").alias("name"), F.lit("").alias("description"), F.col("text").alias("body"), F.lit("").alias("type"))
    return upkeep.write_conflicts(drafts, files).withColumn("similarity", F.round("similarity", 6))


@CATALOG.query("marked_habits", "WITH h AS (SELECT id, max(importance)::BIGINT AS uses, max(last_used_ts) AS lu FROM heuristics WHERE id IS NOT NULL GROUP BY id), m AS (SELECT user_id AS id, count(*) AS n, max(CAST(floor(epoch(ts)) AS BIGINT)) AS tm FROM events GROUP BY user_id) SELECT id, coalesce(uses, 0) + coalesce(n, 0) AS uses, greatest(lu, tm) AS last FROM h LEFT JOIN m USING (id)")
def marked_habits(spark, d):
    rows = table(spark, d, "heuristics").where("id IS NOT NULL").groupBy("id").agg(F.max("importance").cast("long").alias("uses"), F.max("last_used_ts").alias("last"))
    marks = table(spark, d, "events").select(F.col("user_id").cast("long").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return upkeep.marked(rows, marks, "id", "uses", "last")


@CATALOG.query("resolved_conflicts", f"""WITH c AS (SELECT {name_sql("new_file")} AS x, {name_sql("existing_file")} AS y, coalesce(note, '') AS note, resolved FROM conflicts), p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM c WHERE resolved <> 0 AND x IS NOT NULL AND y IS NOT NULL),
j AS (SELECT c.*, p.a IS NOT NULL AND resolved = 0 AS hit FROM c LEFT JOIN p ON least(x, y) = a AND greatest(x, y) = b AND x IS NOT NULL AND y IS NOT NULL)
SELECT x AS new_file, y AS existing_file, CASE WHEN hit THEN note || ' | resolved: manual' ELSE note END AS note, CASE WHEN hit THEN 1 ELSE resolved END AS resolved, count(*) AS n FROM j GROUP BY ALL""")
def resolved_conflicts(spark, d):
    rows = table(spark, d, "conflicts").select(common_file_name("new_file").alias("new_file"), common_file_name("existing_file").alias("existing_file"), F.coalesce("note", F.lit("")).alias("note"), "resolved")
    pairs = rows.where("resolved <> 0 AND new_file IS NOT NULL AND existing_file IS NOT NULL").select(F.col("new_file").alias("a"), F.col("existing_file").alias("b"))
    ordered = rows.withColumn("both", F.col("new_file").isNotNull() & F.col("existing_file").isNotNull())
    return upkeep.resolved_conflicts(ordered, pairs).groupBy("new_file", "existing_file", "note", "resolved").agg(F.count("*").alias("n"))


@CATALOG.query("distiller_sessions", "WITH p AS (SELECT 's' || (doc_id % 6) AS session, CASE WHEN doc_id % 6 = 0 THEN 'Please  DISTIL one reusable' || chr(10) || 'how-to-act heuristic' WHEN doc_id % 6 = 3 THEN 'distill it: a heuristic, reusable' ELSE text END AS t FROM documents) SELECT session, count(*) AS prompts, session IN ('s0', 's3') AS skipped FROM p WHERE t IS NOT NULL GROUP BY session")
def distiller_sessions(spark, d):
    n = F.col("doc_id") % 6
    text = F.when(n == 0, F.lit("Please  DISTIL one reusable\nhow-to-act heuristic")).when(n == 3, F.lit("distill it: a heuristic, reusable")).otherwise(F.col("text"))
    return upkeep.distiller_sessions(table(spark, d, "documents").select(F.concat(F.lit("s"), n.cast("string")).alias("session"), text.alias("t")), "session", "t")


@CATALOG.query("promotion_counts", "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 >= 1 AND NOT (doc_id % 7 = 0 AND session_id IS NOT NULL)) AS eligible, count(*) FILTER (doc_id % 7 = 0 AND session_id IS NOT NULL) AS promoted FROM documents")
def promotion_counts(spark, d):
    return upkeep.promotion_counts(table(spark, d, "documents").select((F.col("doc_id") % 3).alias("referenced_count"), F.when(F.col("doc_id") % 7 == 0, F.col("session_id")).alias("promoted_to")))


@CATALOG.query("session_observations", f"WITH {V.OBS_SQL}, s AS (SELECT session_id, min(ts) AS started_at FROM obs GROUP BY session_id HAVING count(*) > 1) SELECT id, session_id, started_at FROM obs LEFT JOIN s USING (session_id)")
def session_observations(spark, d):
    rows = V.observations(spark, d)
    sessions = rows.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.count("*").alias("n")).where("n > 1")
    return upkeep.with_sessions(rows.select("id", "session_id"), sessions).select("id", "session_id", "started_at")


@CATALOG.query("due_sessions", f"WITH {V.ACCESS_SQL} SELECT session_id, max(ts) AS last, max(ts) > {V.NOW - 3600} OR {V.NOW - 3600} - max(ts) >= 1740 AS due FROM acc WHERE session_id IS NOT NULL GROUP BY session_id")
def due_sessions(spark, d):
    rows = V.access(spark, d).where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("ts").alias("last"))
    return rows.withColumn("due", upkeep.due(F.col("last"), V.NOW - 3600))


def _supposed(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: a fixed note for prompts of even length, nothing usable for others."""
    return prompts.map(lambda p: None if p is None else "A plain note on what was asked." if len(p) % 2 == 0 else "{}")


@CATALOG.query("expanded_queries", f"""WITH {V.DOCS_SQL}, {V.ASKED_SQL}, q AS (SELECT query_id, query, length(trim(coalesce(query, ''))) >= 30 AS wanted FROM asked), h AS (SELECT DISTINCT query FROM q WHERE query_id % 100 = 0 AND query IS NOT NULL),
e AS (SELECT query_id, query, CASE WHEN NOT wanted THEN NULL WHEN query IN (SELECT query FROM h) THEN 'cache' WHEN length(query) % 2 = 0 THEN 'provider' END AS source FROM q)
SELECT query_id, CASE source WHEN 'cache' THEN query || chr(10) || 'Kept.' WHEN 'provider' THEN query || chr(10) || 'A plain note on what was asked.' ELSE query END AS query, coalesce(source, 'none') AS source FROM e""")
def expanded_queries(spark, d):
    asked = V.asked(spark, d)
    cache = asked.where("query_id % 100 = 0 AND query IS NOT NULL").select(text_hash("query", 32).alias("prompt_hash"), F.lit("Kept.").alias("text"), F.lit(V.NOW - 60).cast("long").alias("captured_at"))
    old = cache.select("prompt_hash", F.lit("Stale.").alias("text"), F.lit(V.NOW - 90_000).cast("long").alias("captured_at"))
    return upkeep.expanded_queries(asked, cache.unionByName(old), _supposed, V.NOW)[0]


@CATALOG.query("upserted_habits", f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT * FROM v WHERE id % 2 = 0), a AS (SELECT min(id) AS id, v, count(*) AS times FROM v WHERE id % 50 = 1 GROUP BY v),
c AS (SELECT a.id, times, p.id AS key, list_cosine_similarity(a.v, p.v) AS s FROM a, p WHERE round(list_cosine_similarity(a.v, p.v), 10) >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(s, 10) DESC, p.id) = 1),
r AS (SELECT key AS id, sum(times) AS votes FROM c GROUP BY key)
SELECT id, (3 + coalesce(votes, 0))::BIGINT AS importance, (1 + coalesce(votes, 0))::BIGINT AS corroboration, CASE WHEN votes > 0 THEN {V.NOW} ELSE 5 END::BIGINT AS last_validated_ts FROM p LEFT JOIN r USING (id)
UNION ALL SELECT id, 1 + times, times, {V.NOW} FROM a WHERE id NOT IN (SELECT id FROM c)""")
def upserted_habits(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    pool = rows.where("id % 2 = 0").select("id", "vector", F.lit(3).cast("long").alias("importance"), F.lit(1).cast("long").alias("corroboration"), F.lit(5).cast("long").alias("last_validated_ts"))
    return upkeep.upserted_habits(pool, rows.where("id % 50 = 1"), V.NOW, 0.5).drop("vector")


@CATALOG.query("reviewed_duplicates", f"""WITH {V.FILES_SQL}, {V.RELATED_SQL}, r AS (SELECT DISTINCT least({name_sql("from_file")}, {name_sql("to_file")}) AS a, greatest({name_sql("from_file")}, {name_sql("to_file")}) AS b FROM refs WHERE {name_sql("from_file")} <> {name_sql("to_file")}),
f AS (SELECT file, length(file) % 2 = 0 AS promoted, substr(file, 1, 2) AS session FROM files)
SELECT a, b FROM r JOIN f x ON a = x.file JOIN f y ON b = y.file WHERE NOT EXISTS (SELECT 1 FROM rel WHERE (rel.file = a AND other = b) OR (rel.file = b AND other = a)) AND NOT (x.promoted AND y.promoted AND x.session <> y.session)""")
def reviewed_duplicates(spark, d):
    refs = table(spark, d, "refs").select(common_file_name("from_file").alias("x"), common_file_name("to_file").alias("y")).where("x <> y")
    pairs = refs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    allowed = V.related(spark, d).groupBy("file").agg(F.collect_set("other").alias("dup_ok"))
    files = V.files(spark, d).join(allowed, "file", "left").select("file", "dup_ok", F.when(F.length("file") % 2 == 0, "observer-promoted").alias("origin"), F.substring("file", 1, 2).alias("source_session"))
    return upkeep.deduplicated_pairs(pairs, files).select("a", "b")
