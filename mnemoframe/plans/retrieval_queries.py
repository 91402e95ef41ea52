"""Queries of ranked retrieval: lexical, dense, fused, reranked, and habits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.durable import as_table
from mnemoframe.functions import scores as S
from mnemoframe.functions.text import SEARCH_STOP_WORDS
from mnemoframe.operators import clusters, fusion, lexical, logs, state, vectors
from mnemoframe.plans import views as V
from mnemoframe.plans.tables import table

CATALOG = Catalog()

_W = "CASE lower(coalesce(weight, '')) WHEN 'high' THEN 1.3 WHEN 'medium' THEN 1.1 WHEN 'low' THEN 0.9 ELSE 1.0 END::DOUBLE"
_STATS = f"stats AS (SELECT file, max(ts) AS last, count(*) AS total, count(*) FILTER (ts >= {V.NOW - 30 * 86400}) AS d30, count(*) FILTER (ts >= {V.NOW - 90 * 86400}) AS d90 FROM acc GROUP BY file)"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
#: TF-IDF of the stated queries, to be ranked.
_TFIDF = f"""{V.DOCS_SQL}, {V.ASKED_SQL},
w AS (SELECT doc_id, weight, lower(coalesce(name, '')) AS lname, lower(coalesce(description, '')) AS ldesc, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(body, ''))), '[a-z0-9]+') AS words FROM docs),
t AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w), tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM t GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM docs),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("query")}) AS term FROM asked) GROUP BY ALL),
lexical AS (SELECT query_id, doc_id, {_W.replace("weight", "any_value(weight)")} * sum(times * (tf / dl::DOUBLE * (ln((n + 1) / (df + 1)::DOUBLE) + 1) + CASE WHEN contains(lname, q.term) THEN 0.5 ELSE 0 END + CASE WHEN contains(ldesc, q.term) THEN 0.2 ELSE 0 END)) AS score
  FROM q JOIN tf ON q.term = tf.term JOIN dfs ON dfs.term = q.term JOIN w USING (doc_id), n GROUP BY query_id, doc_id),
lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 24)"""
#: Cosines of the stated query vectors.
_DENSE = """ev AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), eq AS (SELECT * FROM ev WHERE vec_id % 50 = 0),
den AS (SELECT eq.vec_id AS query_id, ev.vec_id AS key, list_cosine_similarity(ev.v, eq.v) AS score, row_number() OVER (PARTITION BY eq.vec_id ORDER BY round(list_cosine_similarity(ev.v, eq.v), 10) DESC, ev.vec_id) AS rank FROM eq, ev QUALIFY rank <= 24)"""


def _lexical(spark, d, k=24):
    return lexical.tfidf_search(V.docs(spark, d), V.asked(spark, d), "doc_id", k, S.weight_factor("weight"))


def _dense(spark, d, k=24):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return vectors.vector_topk(rows, rows.where("key % 50 = 0").withColumnRenamed("key", "query_id"), k)


@CATALOG.query("tfidf_topk", f"WITH {_TFIDF} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 8")
def tfidf_topk(spark, d):
    return _lexical(spark, d, 8).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@CATALOG.query("vector_topk", f"WITH {_DENSE} SELECT query_id, key, round(score, 6) AS score, rank FROM den WHERE rank <= 8")
def vector_topk(spark, d):
    return _dense(spark, d, 8).withColumn("score", F.round("score", 6))


@CATALOG.query("vector_weighted", """WITH ev AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE vec_id % 3 WHEN 0 THEN 1.3 WHEN 1 THEN 1.1 ELSE 0.9 END::DOUBLE AS f FROM embeddings), eq AS (SELECT * FROM ev WHERE vec_id % 50 = 0)
SELECT eq.vec_id AS query_id, ev.vec_id AS key, round(list_cosine_similarity(ev.v, eq.v) * ev.f, 6) AS score, row_number() OVER (PARTITION BY eq.vec_id ORDER BY round(list_cosine_similarity(ev.v, eq.v) * ev.f, 10) DESC, ev.vec_id) AS rank FROM eq, ev QUALIFY rank <= 5""")
def vector_weighted(spark, d):
    factor = F.when(F.col("vec_id") % 3 == 0, 1.3).when(F.col("vec_id") % 3 == 1, 1.1).otherwise(0.9)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), factor.alias("factor"))
    return vectors.vector_topk(rows, rows.where("key % 50 = 0").withColumnRenamed("key", "query_id"), 5, "factor").withColumn("score", F.round("score", 6))


@CATALOG.query("model_guard", "SELECT model, count(*) AS n FROM memory_vectors WHERE model = 'minibge-128' AND len(vector) = dim GROUP BY model")
def model_guard(spark, d):
    return table(spark, d, "memory_vectors").where((F.col("model") == "minibge-128") & (F.size("vector") == F.col("dim"))).groupBy("model").agg(F.count("*").alias("n"))


@CATALOG.query("access_stats", f"WITH {V.ACCESS_SQL}, {_STATS} SELECT * FROM stats")
def access_stats(spark, d):
    return logs.access_stats(V.access(spark, d), V.NOW)


@CATALOG.query("recency_boost", f"WITH {V.ACCESS_SQL}, {_STATS}, {V.FILES_SQL} SELECT file, round(CASE WHEN last IS NULL THEN 1.0 ELSE (1 + least(0.5, 0.05 * coalesce(d30, 0))) * greatest(0.7, exp(-(({V.NOW} - last) / 86400.0::DOUBLE) / 180.0)) END, 6) AS boost, {_W} AS weight_factor FROM files LEFT JOIN stats USING (file)")
def recency_boost(spark, d):
    rows = V.files(spark, d).join(logs.access_stats(V.access(spark, d), V.NOW), "file", "left")
    return rows.select("file", F.round(S.recency_boost("last", "d30", V.NOW), 6).alias("boost"), S.weight_factor("weight").alias("weight_factor"))


@CATALOG.query("decay_scores", f"WITH {V.ACCESS_SQL}, {_STATS}, {V.FILES_SQL} SELECT file, round(CASE WHEN last IS NULL THEN 1.0 ELSE greatest(0.7, exp(-ln(2) * greatest(({V.NOW} - last) / 86400.0::DOUBLE, 0) / CASE weight WHEN 'high' THEN 90 WHEN 'medium' THEN 60 WHEN 'low' THEN 14 ELSE 45 END)) END, 6) AS decay FROM files LEFT JOIN stats USING (file)")
def decay_scores(spark, d):
    rows = V.files(spark, d).join(logs.access_stats(V.access(spark, d), V.NOW), "file", "left")
    return rows.select("file", F.round(S.decay_factor("last", "weight", V.NOW), 6).alias("decay"))


@CATALOG.query("expiry_and_age", f"WITH {V.FILES_SQL} SELECT file, coalesce(TIMESTAMP '2026-06-30 00:00:00' > CAST(try_strptime(trim(expires), '%Y-%m-%d') AS TIMESTAMP), false) AS expired, CAST(floor(({V.NOW} - mtime) / 86400) AS BIGINT) AS age FROM files")
def expiry_and_age(spark, d):
    return V.files(spark, d).select("file", S.is_expired("expires", V.NOW).alias("expired"), S.age_days("mtime", V.NOW).alias("age"))


@CATALOG.query("corroboration_boost", "SELECT id, round(1 + 0.05 * ln(1 + greatest(coalesce(corroboration, 0) - 1, 0)::DOUBLE), 6) AS boost FROM heuristics")
def corroboration_boost(spark, d):
    return table(spark, d, "heuristics").select("id", F.round(S.corroboration_boost("corroboration"), 6).alias("boost"))


@CATALOG.query("rrf_fusion", f"WITH {_TFIDF}, {_DENSE}, v AS (SELECT query_id, doc_id AS key, rank FROM lex UNION ALL SELECT query_id, key, rank FROM den) SELECT query_id, key, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS score FROM v GROUP BY ALL")
def rrf_fusion(spark, d):
    lanes = [_lexical(spark, d).select("query_id", F.col("doc_id").alias("key"), "rank"), _dense(spark, d)]
    return fusion.reciprocal_ranks(lanes).withColumn("score", F.round("score", 8))


_NAMED = """named AS (SELECT DISTINCT query_id, d.doc_id AS key, 1 AS rank FROM asked a JOIN (SELECT doc_id, regexp_extract(text, '([a-z]+_[a-z_]+_[0-9]{4})', 1) AS stem FROM documents) d
  ON length(stem) >= 6 AND contains(replace(lower(query), '_', ' '), replace(lower(stem), '_', ' ')))"""


def _names(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.regexp_extract("text", "([a-z]+_[a-z_]+_[0-9]{4})", 1).alias("filename"))
    return fusion.filename_votes(V.asked(spark, d), rows)


@CATALOG.query("filename_votes", f"WITH {V.DOCS_SQL}, {V.ASKED_SQL}, {_NAMED} SELECT * FROM named")
def filename_votes(spark, d):
    return _names(spark, d)


_EDGES = "ed AS (SELECT a, b, max(decayed) AS decayed FROM (SELECT l_partkey % 400 AS a, l_suppkey + 400 AS b, l_quantity / 100 AS decayed FROM lineitem) GROUP BY a, b)"


def _edges(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("a"), (F.col("l_suppkey") + 400).alias("b"), (F.col("l_quantity") / 100).alias("decayed"))
    return rows.groupBy("a", "b").agg(F.max("decayed").alias("decayed"))


_SPREAD = """sd AS (SELECT query_id, key, score FROM {0} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) <= 5),
bo AS (SELECT a AS seed, b AS key, decayed FROM ed UNION ALL SELECT b, a, decayed FROM ed),
nb AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY decayed DESC, key) AS n FROM bo QUALIFY n <= 8),
sp AS (SELECT sd.query_id, nb.key, sum(nb.decayed) AS score FROM sd JOIN nb ON sd.key = nb.seed WHERE NOT EXISTS (SELECT 1 FROM sd s WHERE s.query_id = sd.query_id AND s.key = nb.key) GROUP BY ALL),
spr AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) AS rank FROM sp QUALIFY rank <= 8)"""


@CATALOG.query("spread_activation", f"WITH {_DENSE}, {_EDGES}, {_SPREAD.format('den')} SELECT query_id, key, round(score, 6) AS score, rank FROM spr")
def spread_activation(spark, d):
    seeds = lexical.top_ranked(_dense(spark, d).drop("rank"), 5, ["query_id"], [F.desc(F.round("score", 10)), F.col("key")]).select("query_id", "key")
    return fusion.spread(seeds, _edges(spark, d), k=8).withColumn("score", F.round("score", 6))


_HYBRID = f"""{_TFIDF}, {_DENSE}, {_EDGES}, {_NAMED},
wd AS (SELECT DISTINCT query_id FROM den),
fl AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM lex WHERE query_id IN (SELECT query_id FROM wd)),
so AS (SELECT query_id, key, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, key, rank FROM fl UNION ALL SELECT query_id, key, rank FROM den) GROUP BY ALL),
{_SPREAD.format('so')},
fu AS (SELECT query_id, key, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, key, rank FROM fl UNION ALL SELECT query_id, key, rank FROM den UNION ALL SELECT query_id, key, rank FROM spr UNION ALL SELECT query_id, key, rank FROM named WHERE query_id IN (SELECT query_id FROM wd)) GROUP BY ALL),
fc AS (SELECT doc_id AS key, CASE weight WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.95 ELSE 0.9 END::DOUBLE AS factor FROM docs),
al AS (SELECT query_id, key, score * coalesce(factor, 1.0) AS score FROM fu LEFT JOIN fc USING (key) UNION ALL SELECT query_id, doc_id, score FROM lex WHERE query_id NOT IN (SELECT query_id FROM wd)),
hybrid AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) AS rank FROM al QUALIFY rank <= 8)"""


def _hybrid(spark, d, ranked=None):
    factors = V.docs(spark, d).select(F.col("doc_id").alias("key"), F.when(F.col("weight") == "high", 1.0).when(F.col("weight") == "medium", 0.95).otherwise(0.9).alias("factor"))
    return fusion.hybrid_search((_lexical(spark, d) if ranked is None else ranked).select("query_id", F.col("doc_id").alias("key"), "score"), _dense(spark, d).drop("rank"), None, _edges(spark, d), _names(spark, d), factors, 8)


@CATALOG.query("hybrid_search", f"WITH {_HYBRID} SELECT query_id, key, round(score, 8) AS score, rank FROM hybrid")
def hybrid_search(spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 8))


_OVERLAP = "CASE WHEN len(list_distinct(qt)) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(qt), tt)) / len(list_distinct(qt))::DOUBLE END"
_RERANK = f"""{_TFIDF}, pool AS (SELECT query_id, doc_id AS key, score FROM lex WHERE rank <= 20),
pt AS (SELECT query_id, key, score, {_TOK.format("query")} AS qt, regexp_extract_all(lower(coalesce(name, '') || chr(10) || coalesce(description, '') || chr(10) || substr(coalesce(body, ''), 1, 2000)), '[a-z0-9]+') AS tt FROM pool JOIN asked USING (query_id) JOIN docs ON doc_id = key),
rr AS (SELECT query_id, key, score, {_OVERLAP} AS rerank_score FROM pt),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, round(score, 10) DESC, key) AS rank FROM rr QUALIFY rank <= 8)"""


def _pool(spark, d):
    rows = lexical.tfidf_search(V.docs(spark, d), V.asked(spark, d), "doc_id", 20, S.weight_factor("weight")).select("query_id", F.col("doc_id").alias("key"), F.round("score", 10).alias("score"))
    return rows.join(V.asked(spark, d), "query_id").join(V.docs(spark, d).select(F.col("doc_id").alias("key"), "name", "description", "body"), "key")


@CATALOG.query("reranked", f"WITH {_RERANK} SELECT query_id, key, round(rerank_score, 6) AS rerank_score, round(score, 6) AS score, rank FROM rk WHERE rerank_score >= 0.5")
def reranked(spark, d):
    out = fusion.reranked(_pool(spark, d), floor=0.5)
    return out.select("query_id", "key", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"), "rank")


@CATALOG.query("floor_outcomes", f"WITH {_RERANK} SELECT query_id, count(*) AS candidates, count(*) FILTER (rerank_score >= 0.999) AS kept, count(*) FILTER (rerank_score >= 0.999) = 0 AS suppressed_all FROM rk GROUP BY query_id")
def floor_outcomes(spark, d):
    before = as_table(fusion.reranked(_pool(spark, d)), "reranked")
    return fusion.floor_outcome(before, before.where("rerank_score >= 0.999"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in SEARCH_STOP_WORDS)
_RECENT = f"""{V.DOCS_SQL}, {V.ASKED_SQL},
qw AS (SELECT query_id, unnest(list_slice(u, 1, 6)) AS word FROM (SELECT query_id, list_transform(list_distinct_ordered, lambda x: x) AS u FROM (SELECT query_id, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i) GROUP BY w)) AS list_distinct_ordered
  FROM (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]{{2,}}'), lambda x: NOT list_contains([{_STOP}], x)) AS l FROM asked)))),
qp AS (SELECT query_id, word, unnest(list_distinct(regexp_extract_all(word, '[a-z0-9]+'))) AS term, len(list_distinct(regexp_extract_all(word, '[a-z0-9]+'))) AS needed FROM qw),
ix AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM documents),
hit AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, word, doc_id, count(*) AS n, any_value(needed) AS needed FROM qp JOIN ix USING (term) GROUP BY ALL HAVING count(*) = any_value(needed))),
recent AS (SELECT query_id, doc_id, written_at, 0.5 AS score, row_number() OVER (PARTITION BY query_id ORDER BY written_at DESC NULLS LAST, doc_id) AS rank FROM hit JOIN documents USING (doc_id) QUALIFY rank <= 3)"""


@CATALOG.query("recent_matches", f"WITH {_RECENT} SELECT query_id, doc_id, rank FROM recent")
def recent_matches(spark, d):
    return lexical.recent_matches(table(spark, d, "documents"), V.asked(spark, d), "doc_id", "text", "written_at").select("query_id", "doc_id", "rank")


_EPILOGUE = "lower(trim(coalesce(source, ''))) = 'session_epilogue'"
_ROWS_ONLY, _SUMMARIES_ONLY = (f"(SELECT * FROM documents WHERE {c}) AS documents" for c in (f"NOT ({_EPILOGUE})", _EPILOGUE))
_IX, _AFTER = _RECENT.index("ix AS ("), _RECENT[_RECENT.index("ix AS (") :]


@CATALOG.query("merged_matches", f"""WITH {_RECENT[:_IX]}{_AFTER.replace("FROM documents", "FROM " + _ROWS_ONLY).replace("JOIN documents", "JOIN " + _ROWS_ONLY)},
{_AFTER.replace("FROM documents", "FROM " + _SUMMARIES_ONLY).replace("JOIN documents", "JOIN " + _SUMMARIES_ONLY).replace("ix AS", "ix2 AS").replace("JOIN ix ", "JOIN ix2 ").replace("hit AS", "hit2 AS").replace("FROM hit ", "FROM hit2 ").replace("recent AS", "recent2 AS").replace("0.5 AS score", "0.55 AS score")},
mm AS (SELECT query_id, doc_id, written_at, score FROM recent UNION ALL SELECT query_id, doc_id, written_at, score FROM recent2)
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY written_at DESC NULLS LAST, score DESC, doc_id) AS rank FROM mm QUALIFY rank <= 3""")
def merged_matches(spark, d):
    """Rows and session summaries that match, in one list, newest first."""
    docs, asked = table(spark, d, "documents"), V.asked(spark, d)
    summary = F.coalesce(F.lower(F.btrim("source")) == "session_epilogue", F.lit(False))
    rows = lexical.recent_matches(docs.where(~summary), asked, "doc_id", "text", "written_at").withColumnRenamed("doc_id", "key")
    summaries = lexical.recent_matches(docs.where(summary), asked, "doc_id", "text", "written_at", score=0.55).withColumnRenamed("doc_id", "key")
    return lexical.merged_matches(rows, summaries, "written_at", 3).select("query_id", F.col("key").alias("doc_id"), "score", "rank")


@CATALOG.query("phrase_search", f"""WITH {V.DOCS_SQL}, {V.ASKED_SQL},
pw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2)) AS word FROM asked),
ph AS (SELECT query_id, doc_id, sum((length(lower(body)) - length(replace(lower(body), word, ''))) // length(word)) AS score FROM pw JOIN docs ON contains(lower(body), word) GROUP BY ALL)
SELECT query_id, doc_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ph QUALIFY rank <= 8""")
def phrase_search(spark, d):
    return lexical.phrase_search(V.docs(spark, d), V.asked(spark, d), lines=False).select("query_id", "doc_id", "score", "rank")


@CATALOG.query("prompt_hits", f"""WITH {_HYBRID}, good AS (SELECT query_id, key, score FROM hybrid WHERE score >= 0.012 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 3),
strong AS (SELECT query_id FROM hybrid GROUP BY query_id HAVING max(score) >= 0.04),
fb AS (SELECT query_id, doc_id AS key, score FROM lex WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM strong))
SELECT query_id, key, round(score, 6) AS score, 'memory' AS layer FROM good UNION ALL SELECT query_id, key, round(score, 6), 'observer' FROM fb""")
def prompt_hits(spark, d):
    ranked = as_table(_lexical(spark, d), "lexical")
    fallback = ranked.where("rank <= 3").select("query_id", F.col("doc_id").alias("key"), "score")
    # Scores are rounded before they order, so that ties are the same everywhere.
    return fusion.prompt_hits(as_table(_hybrid(spark, d, ranked), "hybrid").drop("rank").withColumn("score", F.round("score", 12)), fallback).withColumn("score", F.round("score", 6))


@CATALOG.query("unified_recall", f"""WITH {_TFIDF}, {_DENSE} SELECT query_id, 'notes' AS layer, CAST(doc_id AS VARCHAR) AS key, round(score, 3) AS score, name AS snippet FROM lex JOIN docs USING (doc_id) WHERE rank <= 3
UNION ALL SELECT query_id, 'vectors', CAST(key AS VARCHAR), round(score, 3), CAST(label AS VARCHAR) FROM den JOIN embeddings ON key = vec_id WHERE rank <= 3""")
def unified_recall(spark, d):
    notes = _lexical(spark, d, 3).join(V.docs(spark, d).select("doc_id", F.col("name").alias("snippet")), "doc_id").withColumnRenamed("doc_id", "key")
    dense = _dense(spark, d, 3).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("snippet")), "key")
    return fusion.unified_recall({"notes": notes, "vectors": dense})


_HABIT = f"""hs AS (SELECT DISTINCT * FROM heuristics), eq AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), hq AS (SELECT vec_id AS query_id, v FROM eq WHERE vec_id % 50 = 0),
hc AS (SELECT query_id, vec_id + 1 AS id, list_cosine_similarity(eq.v, hq.v) AS cosine FROM hq, eq),
hh AS (SELECT id, max(importance) AS importance, max(corroboration) AS corroboration, max(last_validated_ts) AS lv, max(created_ts) AS cr, max(status) AS status FROM hs GROUP BY id),
hr AS (SELECT query_id, id, cosine, cosine * exp(-ln(2) * greatest(({V.NOW} - coalesce(lv, cr, {V.NOW})) / 86400.0::DOUBLE, 0) / 60) * (1 + 0.05 * ln(1 + greatest(coalesce(corroboration, 0) - 1, 0)::DOUBLE)) AS score FROM hc JOIN hh USING (id) WHERE cosine > 0 AND status = 'active' AND coalesce(importance, 0) >= 1)"""


def _habits(spark, d):
    rows = table(spark, d, "heuristics").groupBy("id").agg(*[F.max(c).alias(c) for c in ("importance", "corroboration", "last_validated_ts", "created_ts", "status")])
    return rows


@CATALOG.query("habit_scores", f"WITH {_HABIT} SELECT query_id, id, round(cosine, 6) AS cosine, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id) AS rank, round(cosine, 10) >= 0.62 AS inject FROM hr QUALIFY rank <= 3")
def habit_scores(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("key"), F.col("embedding").alias("vector"))
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    cosines = vectors.vector_topk(rows, asked, 1 << 30).select("query_id", F.col("key").alias("id"), F.col("score").alias("cosine"))
    out = clusters.habit_scores(cosines, _habits(spark, d), V.NOW)
    return out.select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "rank", "inject")


@CATALOG.query("habit_list", "SELECT id, coalesce(importance, 0) * coalesce(corroboration, 0) AS strength FROM (SELECT id, max(importance) AS importance, max(corroboration) AS corroboration, max(last_validated_ts) AS lv, max(status) AS status FROM heuristics GROUP BY id) WHERE status = 'active' ORDER BY strength DESC, lv DESC NULLS LAST, id LIMIT 5")
def habit_list(spark, d):
    return clusters.habit_list(_habits(spark, d))


@CATALOG.query("exact_votes", """WITH h AS (SELECT id, min(batch_no) AS b, min(trigger) AS trigger FROM heuristics WHERE trigger IS NOT NULL GROUP BY id), f AS (SELECT trigger, min((CASE WHEN b > 0 THEN 1 ELSE 0 END) * 1000000000000 + id) % 1000000000000 AS habit FROM h GROUP BY trigger)
SELECT id, habit, id = habit AS is_new FROM h JOIN f USING (trigger) WHERE b > 0""")
def exact_votes(spark, d):
    rows = table(spark, d, "heuristics").where("trigger IS NOT NULL").groupBy("id").agg(F.min("batch_no").alias("b"), F.min("trigger").alias("trigger"))
    return clusters.exact_votes(rows.where("b = 0"), rows.where("b > 0"))


@CATALOG.query("prompts_wanted", "SELECT doc_id, length(trim(coalesce(text, ''))) >= 10 AND NOT starts_with(trim(coalesce(text, '')), '/') AS wanted FROM documents")
def prompts_wanted(spark, d):
    return table(spark, d, "documents").select("doc_id", fusion.prompt_wanted("text").alias("wanted"))


@CATALOG.query("cache_usable", f"SELECT doc_id, coalesce(n_chars >= 2048 AND n_chars <= 16384 AND {V.NOW} - epoch(written_at) <= 86400, false) AS usable FROM documents")
def cache_usable(spark, d):
    at = F.unix_micros("written_at") / F.lit(1e6)
    return table(spark, d, "documents").select("doc_id", state.cache_usable(F.col("n_chars"), at, at, V.NOW).alias("usable"))
