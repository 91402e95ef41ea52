"""Queries of similarity, clustering, novelty, evaluation, audits and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.durable import as_table
from mnemoframe.functions import scores as S
from mnemoframe.functions.names import common_file_name
from mnemoframe.operators import audits, clusters, evaluation, lexical, logs, vectors
from mnemoframe.plans import retrieval_queries as R
from mnemoframe.plans import views as V
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

CATALOG = Catalog()

_COUNTS = """c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
k AS (SELECT doc_id, string_agg(term || ':' || tf, ' ' ORDER BY term) AS sig, sqrt(sum(tf * tf)) AS norm FROM c GROUP BY doc_id), f AS (SELECT sig, min(doc_id) AS class, any_value(norm) AS norm FROM k GROUP BY sig), cc AS (SELECT c.* FROM c JOIN f ON doc_id = class)"""


@CATALOG.query("similar_texts", f"WITH {_COUNTS}, p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.tf * y.tf) AS dot FROM cc x JOIN cc y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a, b, round(dot / (u.norm * v.norm), 6) AS similarity FROM p JOIN f u ON a = u.class JOIN f v ON b = v.class WHERE dot / (u.norm * v.norm) >= 0.9")
def similar_texts(spark, d):
    return lexical.similar_texts(table(spark, d, "documents"), "doc_id", "text", 0.9, places=6)


_SIMILAR = f"WITH {_COUNTS}, p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.tf * y.tf) AS dot FROM cc x JOIN cc y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL), s AS (SELECT a, b, dot / (u.norm * v.norm) AS similarity FROM p JOIN f u ON a = u.class JOIN f v ON b = v.class)"


@CATALOG.query("duplicate_texts", f"{_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 12) >= 0.55")
def duplicate_texts(spark, d):
    """Pairs of texts from the duplicate limit on; ``similar_texts`` has only the near copies among them."""
    return lexical.similar_texts(table(spark, d, "documents"), "doc_id", "text", places=6)


@CATALOG.query("audit_duplicate_texts", f"{_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 12) >= 0.70")
def audit_duplicate_texts(spark, d):
    return lexical.similar_texts(table(spark, d, "documents"), "doc_id", "text", lexical.AUDITED_DUPLICATE, places=6)


@CATALOG.query("text_classes", f"WITH {_COUNTS} SELECT doc_id AS key, class FROM k JOIN f USING (sig)")
def text_classes(spark, d):
    return lexical.text_members(table(spark, d, "documents"), "doc_id", "text").select("key", "class")


_MV = f"""mv AS (SELECT {name_sql('filename')} AS key, arg_max(vector::DOUBLE[], mtime) AS v, max(mtime) AS mtime FROM memory_vectors WHERE model = 'minibge-128' AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {name_sql('filename')} IS NOT NULL GROUP BY 1),
nz AS (SELECT * FROM mv WHERE len(list_filter(v, lambda x: x <> 0)) > 0)"""


def _memory_vectors(spark, d):
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table(spark, d, "memory_vectors").where((F.col("model") == "minibge-128") & (F.size("vector") == F.col("dim")) & finite).withColumn("key", common_file_name("filename")).where("key IS NOT NULL")
    best = rows.groupBy("key").agg(F.max_by("vector", "mtime").alias("vector"), F.max("mtime").alias("mtime"))
    return best.where(F.exists("vector", lambda x: x != 0))


@CATALOG.query("near_duplicates", f"""WITH {_MV}, {V.RELATED_SQL}, p AS (SELECT x.key AS a, y.key AS b, list_cosine_similarity(x.v, y.v) AS s, x.v = y.v AS same FROM nz x JOIN nz y ON x.key < y.key WHERE round(list_cosine_similarity(x.v, y.v), 10) >= 0.92),
f AS (SELECT v, min(key) AS first FROM nz GROUP BY v), q AS (SELECT * FROM p WHERE (NOT same AND a IN (SELECT first FROM f) AND b IN (SELECT first FROM f)) OR (same AND a IN (SELECT first FROM f))),
r AS (SELECT DISTINCT least(file, other) AS a, greatest(file, other) AS b FROM rel WHERE file IS NOT NULL AND other IS NOT NULL)
SELECT q.a, q.b, round(s, 6) AS similarity, r.a IS NOT NULL OR (starts_with(q.a, 'digest_') AND starts_with(q.b, 'digest_')) OR (starts_with(q.a, 'session_handoff_') AND starts_with(q.b, 'session_handoff_')) AS intended FROM q LEFT JOIN r ON q.a = r.a AND q.b = r.b""")
def near_duplicates(spark, d):
    links = V.related(spark, d).where("file IS NOT NULL").groupBy("file").agg(F.collect_set("other").alias("related")).withColumnRenamed("file", "key")
    return clusters.near_duplicates(_memory_vectors(spark, d).select("key", "vector"), links).withColumn("similarity", F.round("similarity", 6))


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@CATALOG.query("suggested_links", f"""WITH {_E}, h AS (SELECT vec_id % 50 = 0 AS asked, * FROM e), n AS (SELECT x.vec_id AS f, y.vec_id AS o, list_cosine_similarity(x.v, y.v) AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.v, y.v), 10) DESC, y.vec_id) AS r FROM h x, e y WHERE x.asked QUALIFY r <= 12),
m AS (SELECT 'v' || f AS file, 'v' || o AS other, s FROM n WHERE f <> o AND o <> f + 1), g AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(s, 10) DESC, other) AS k FROM m) SELECT file, other, round(s, 6) AS similarity FROM g WHERE k <= 4 AND round(s, 10) >= 0.3""")
def suggested_links(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    near = vectors.vector_topk(rows, rows.where("key % 50 = 0").withColumnRenamed("key", "query_id"), 12)
    named = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    neighbours = near.select(named("query_id").alias("file"), named("key").alias("other"), F.col("score").alias("similarity"))
    existing = rows.select(named("key").alias("file"), F.array(F.concat(F.lit("v"), (F.col("key") + 1).cast("string"))).alias("related"))
    return clusters.suggested_links(neighbours, existing, 0.3).withColumn("similarity", F.round("similarity", 6))


@CATALOG.query("novelty", f"WITH {_E}, k AS (SELECT * FROM e WHERE vec_id % 50 <> 0), p AS (SELECT x.vec_id AS key, y.vec_id AS closest, list_cosine_similarity(x.v, y.v) AS s FROM e x, k y WHERE x.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.v, y.v), 10) DESC, y.vec_id) = 1) SELECT key, closest, round(s, 6) AS similarity, CASE WHEN s < 0.3 THEN 'HIGH' WHEN s < 0.4 THEN 'MEDIUM' WHEN s < 0.5 THEN 'LOW' ELSE 'known' END AS tier FROM p")
def novelty(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    best = clusters.closest_known(rows.where("key % 50 = 0"), rows.where("key % 50 <> 0"))
    return best.select("key", "closest", F.round("similarity", 6).alias("similarity"), S.novelty_tier("similarity").alias("tier"))


@CATALOG.query("coverage", f"WITH {_E}, k AS (SELECT * FROM e WHERE vec_id % 50 <> 0), p AS (SELECT x.vec_id AS key, y.vec_id AS closest, list_cosine_similarity(x.v, y.v) AS s FROM e x, k y WHERE x.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.v, y.v), 10) DESC, y.vec_id) = 1) SELECT key, closest, round(s, 6) AS similarity, s >= 0.88 AS covered FROM p")
def coverage(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return clusters.coverage(rows.where("key % 50 = 0"), rows.where("key % 50 <> 0")).withColumn("similarity", F.round("similarity", 6))


@CATALOG.query("citation_overlap", "WITH c AS (SELECT DISTINCT l_orderkey AS draft, l_partkey AS r FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS candidate, l_partkey AS r FROM lineitem WHERE l_quantity > 25), z AS (SELECT draft, count(*) AS n FROM c GROUP BY draft), o AS (SELECT draft, candidate, count(*) / any_value(z.n)::DOUBLE AS overlap FROM c JOIN m USING (r) JOIN z USING (draft) GROUP BY ALL) SELECT draft, candidate, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.5 THEN 'corroborate' ELSE 'new' END AS verdict FROM o QUALIFY row_number() OVER (PARTITION BY draft ORDER BY overlap DESC, candidate) = 1")
def citation_overlap(spark, d):
    rows = table(spark, d, "lineitem")
    out = clusters.citation_overlap(rows.select(F.col("l_orderkey").alias("draft"), F.col("l_partkey").alias("row")), rows.where("l_quantity > 25").select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("row")))
    return out.select("draft", "candidate", F.round("overlap", 6).alias("overlap"), clusters.pending_verdict(F.col("overlap"), F.lit(None)).alias("verdict"))


@CATALOG.query("cluster_seed")
def cluster_seed(spark, d):
    return clusters.sequential_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "vec_id", "seed", 0.35)


@CATALOG.query("cluster_centroid")
def cluster_centroid(spark, d):
    return clusters.sequential_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", -F.col("vec_id"), "centroid", 0.35)


@CATALOG.query("cluster_facts", "WITH c AS (SELECT o_custkey AS cluster, count(*) AS size, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1) SELECT *, last_day - first_day AS span_days, CASE WHEN size >= 5 AND last_day - first_day >= 14 THEN 'HIGH' WHEN size >= 3 AND last_day - first_day >= 7 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM c")
def cluster_facts(spark, d):
    return clusters.cluster_facts(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderdate").cast("date").alias("day")), "day")


@CATALOG.query("cluster_scores", "SELECT o_custkey, round_even(least(1.0, count(*) FILTER (o_orderstatus = 'F') / 10.0::DOUBLE + 0.05 * count(*)), 2) AS score FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') >= 1 AND count(*) >= 2")
def cluster_scores(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("refs"), F.count("*").alias("n"))
    return rows.where("refs >= 1 AND n >= 2").select("o_custkey", S.cluster_score("refs", "n").alias("score"))


@CATALOG.query("adjacent_drift", f"WITH {_E}, p AS (SELECT vec_id AS key, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS pv FROM e) SELECT key, label, round(list_cosine_similarity(pv, v), 6) AS similarity, CASE WHEN pv IS NULL THEN NULL WHEN list_cosine_similarity(pv, v) >= 0.85 THEN 'TIGHT' WHEN list_cosine_similarity(pv, v) >= 0.7 THEN 'NORMAL' ELSE 'INVESTIGATE' END AS verdict FROM p")
def adjacent_drift(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("vec_id").alias("tm"), "label", F.col("embedding").alias("vector"))
    out = clusters.adjacent_drift(rows, "key", "tm", "vector", ["label"])
    return out.select("key", "label", F.round("similarity", 6).alias("similarity"), S.probe_verdict("similarity").alias("verdict"))


@CATALOG.query("drift_summary", f"WITH {_E}, p AS (SELECT label, list_cosine_similarity(lag(v) OVER (PARTITION BY label ORDER BY vec_id), v) AS s FROM e) SELECT label, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most, count(*) FILTER (s < 0.7) AS investigate FROM p GROUP BY label")
def drift_summary(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("vec_id").alias("tm"), "label", F.col("embedding").alias("vector"))
    out = clusters.adjacent_drift(rows, "key", "tm", "vector", ["label"])
    return out.groupBy("label").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"), F.count_if(F.col("similarity") < 0.7).alias("investigate"))


_CASES = f"{R._TFIDF}, cr AS (SELECT query_id AS id, min(rank) AS rank FROM lex WHERE rank <= 8 AND doc_id = query_id GROUP BY 1), res AS (SELECT a.query_id AS id, cr.rank IS NOT NULL AS passed, cr.rank FROM asked a LEFT JOIN cr ON cr.id = a.query_id)"


def _floor(spark, d, k=8):
    cases = V.asked(spark, d).select(F.col("query_id").alias("id"), F.array("query_id").alias("expected"))
    hits = R._lexical(spark, d, k).select(F.col("query_id").alias("id"), F.col("doc_id").alias("key"), "rank")
    return evaluation.case_results(cases, hits, k)


@CATALOG.query("floor_suite", f"WITH {_CASES} SELECT id, passed, rank FROM res")
def floor_suite(spark, d):
    return _floor(spark, d).select("id", "passed", "rank")


@CATALOG.query("run_summary", f"WITH {_CASES} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS pass_rate, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 6) AS mrr FROM res")
def run_summary(spark, d):
    return evaluation.run_summary(_floor(spark, d)).withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("mrr", F.round("mrr", 6))


@CATALOG.query("run_difference", f"WITH {_CASES}, b AS (SELECT id, id % 3 <> 0 AS passed, CASE WHEN id % 3 <> 0 THEN 1 + id % 2 END AS rank FROM res), j AS (SELECT id, CASE WHEN b.passed AND NOT c.passed THEN 'regression' WHEN NOT b.passed AND c.passed THEN 'new pass' WHEN b.rank <> c.rank THEN 'rank drift' END AS change, b.rank AS rank_before, c.rank AS rank_now FROM res c JOIN b USING (id)) SELECT * FROM j WHERE change IS NOT NULL")
def run_difference(spark, d):
    current = as_table(_floor(spark, d), "run")
    baseline = current.select("id", (F.col("id") % 3 != 0).alias("passed"), F.when(F.col("id") % 3 != 0, 1 + F.col("id") % 2).alias("rank"))
    return evaluation.run_difference(baseline, current)


@CATALOG.query("false_injects", f"WITH {R._DENSE}, x AS (SELECT DISTINCT query_id FROM den), y AS (SELECT DISTINCT query_id FROM den WHERE rank BETWEEN 2 AND 4 AND round(score, 10) >= 0.45) SELECT count(*) AS distractors, count(y.query_id) AS leaks, round(count(y.query_id) / count(*)::DOUBLE, 6) AS rate FROM x LEFT JOIN y USING (query_id)")
def false_injects(spark, d):
    hits = R._dense(spark, d, 4).where("rank >= 2").select(F.col("query_id").alias("id"), (F.col("rank") - 1).alias("rank"), F.col("score").alias("cosine"))
    return evaluation.false_injects(hits.select("id").distinct(), hits, 0.45).withColumn("rate", F.round("rate", 6))


_ISSUES = f"""{V.ACCESS_SQL}, {V.FILES_SQL}, st AS (SELECT file, count(*) FILTER (ts >= {V.NOW - 30 * 86400}) AS d30 FROM acc GROUP BY file), fx AS (SELECT files.*, coalesce(d30, 0) AS d30 FROM files LEFT JOIN st USING (file)),
iss AS (SELECT 'expired' AS issue, file AS key FROM fx WHERE coalesce(TIMESTAMP '2026-06-30 00:00:00' > CAST(try_strptime(trim(expires), '%Y-%m-%d') AS TIMESTAMP), false) UNION ALL SELECT 'stale', file FROM fx WHERE floor(({V.NOW} - mtime) / 86400) > 60 AND d30 = 0
UNION ALL SELECT 'untyped', file FROM fx WHERE coalesce(type, '') = '' UNION ALL SELECT 'no_description', file FROM fx WHERE coalesce(description, '') = '')"""


def _issues(spark, d):
    return audits.file_issues(V.files(spark, d), logs.access_stats(V.access(spark, d), V.NOW), V.NOW)


@CATALOG.query("file_issues", f"WITH {_ISSUES} SELECT issue, key FROM iss")
def file_issues(spark, d):
    return _issues(spark, d)


@CATALOG.query("issue_counts", f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM iss GROUP BY issue")
def issue_counts(spark, d):
    return audits.issue_counts(_issues(spark, d))


_ALL_ISSUES = f"""{_ISSUES}, vk AS (SELECT DISTINCT {name_sql("filename")} AS key FROM memory_vectors WHERE {name_sql("filename")} IS NOT NULL), fk AS (SELECT file AS key FROM files),
ai AS (SELECT issue, CAST(key AS VARCHAR) AS key FROM iss UNION ALL SELECT 'missing', key FROM vk WHERE key NOT IN (SELECT key FROM fk) UNION ALL SELECT 'unindexed', key FROM fk WHERE key NOT IN (SELECT key FROM vk))"""


def _all_issues(spark, d):
    """The files' own issues, vectors without a file and files without a vector."""
    vectors_of = table(spark, d, "memory_vectors").select(common_file_name("filename").alias("key"))
    return _issues(spark, d).unionByName(audits.two_way_orphans(vectors_of, V.files(spark, d).select(F.col("file").alias("key"))))


@CATALOG.query("audit_issues", f"WITH {_ALL_ISSUES} SELECT issue, key FROM ai")
def audit_issues(spark, d):
    return _all_issues(spark, d)


@CATALOG.query("health_score", f"WITH {_ALL_ISSUES}, c AS (SELECT issue, count(*) AS n FROM ai GROUP BY issue), p AS (SELECT coalesce(sum(least(n * CASE issue WHEN 'missing' THEN 10 WHEN 'expired' THEN 5 WHEN 'duplicates' THEN 3 WHEN 'untyped' THEN 2 WHEN 'unindexed' THEN 1 ELSE 0 END, 30)), 0)::BIGINT AS penalty FROM c) SELECT penalty, greatest(0, 100 - penalty)::BIGINT AS score FROM p")
def health_score(spark, d):
    return audits.health_score(audits.issue_counts(_all_issues(spark, d)))


@CATALOG.query("health_invariants", f"""WITH {V.JOBS_SQL}, la AS (SELECT event_id, arg_max(status, seq) AS status FROM jobs GROUP BY event_id) SELECT 'pending' AS "check", count(*) FILTER (status = 'pending')::DOUBLE AS value, 50.0::DOUBLE AS most, count(*) FILTER (status = 'pending') <= 50 AS ok FROM la
UNION ALL SELECT 'dead', count(*) FILTER (status IN ('dead', 'failed')), 0, count(*) FILTER (status IN ('dead', 'failed')) <= 0 FROM la
UNION ALL SELECT 'newest_event_age', {V.EVENTS_NOW} - max(tm), 172800, {V.EVENTS_NOW} - max(tm) <= 172800 FROM jobs""")
def health_invariants(spark, d):
    from mnemoframe.operators.state import latest_rows

    jobs = V.jobs(spark, d)
    last = latest_rows(jobs, "event_id", "seq")
    return audits.invariants([
        ("pending", last, F.count_if(F.col("status") == "pending"), 50),
        ("dead", last, F.count_if(F.col("status").isin("dead", "failed")), 0),
        ("newest_event_age", jobs, F.lit(V.EVENTS_NOW) - F.max("at"), 172800),
    ])


@CATALOG.query("incomplete_files", f"WITH {V.FILES_SQL} SELECT file AS key, concat_ws(',', CASE WHEN coalesce(trim(name), '') = '' THEN 'name' END, CASE WHEN coalesce(trim(description), '') = '' THEN 'description' END, CASE WHEN coalesce(trim(type), '') = '' THEN 'type' END, CASE WHEN coalesce(trim(weight), '') = '' THEN 'weight' END) AS lacking FROM files WHERE lacking <> ''")
def incomplete_files(spark, d):
    return audits.incomplete(V.files(spark, d), ("name", "description", "type", "weight"))


@CATALOG.query("top_hubs", f"WITH r AS (SELECT DISTINCT {name_sql('from_file')} AS f, {name_sql('to_file')} AS t FROM refs) SELECT t AS file, count(*) AS incoming FROM r WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY t ORDER BY incoming DESC, file LIMIT 8")
def top_hubs(spark, d):
    rows = table(spark, d, "refs").select(common_file_name("from_file").alias("from_file"), common_file_name("to_file").alias("to_file")).where("from_file IS NOT NULL AND to_file IS NOT NULL")
    return audits.top_hubs(rows)


@CATALOG.query("score_distribution", "SELECT CASE WHEN starts_with(filename, 'self_') THEN 'self' WHEN starts_with(filename, 'feedback_') THEN 'feedback' WHEN starts_with(filename, 'user_') THEN 'user' ELSE 'other' END AS kind, count(*) AS n, round(avg(dim), 2) AS mean FROM memory_vectors GROUP BY 1")
def score_distribution(spark, d):
    kind = F.when(F.startswith("filename", F.lit("self_")), "self").when(F.startswith("filename", F.lit("feedback_")), "feedback").when(F.startswith("filename", F.lit("user_")), "user").otherwise("other")
    return table(spark, d, "memory_vectors").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("dim"), 2).alias("mean"))


@CATALOG.query("token_jaccard", f"WITH h AS (SELECT id, min(trigger) AS trigger, min(action) AS action FROM heuristics GROUP BY id), w AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(trigger, '')), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(action, '')), '[a-z0-9_]+')) AS b FROM h) SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS jaccard FROM w")
def token_jaccard(spark, d):
    from mnemoframe.functions.text import jaccard, word_set

    rows = table(spark, d, "heuristics").groupBy("id").agg(F.min("trigger").alias("trigger"), F.min("action").alias("action"))
    return rows.select("id", F.round(jaccard(word_set("trigger"), word_set("action")), 6).alias("jaccard"))
