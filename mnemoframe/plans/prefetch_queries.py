"""The prompt path from end to end: hybrid search with the graph's lane, rerank, floor, fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.durable import as_table
from mnemoframe.operators import fusion
from mnemoframe.operators import graph as G
from mnemoframe.plans import graph_queries as Q
from mnemoframe.plans import retrieval_queries as R
from mnemoframe.plans import views as V

CATALOG = Catalog()

_PPR = Q.ppr_ctes("SELECT query_id, 101 + query_id % 25 AS node, 1.0::DOUBLE AS rank FROM asked")
_GRAPH = f"{_PPR}, {Q.RANKED_FILES_SQL}, gl AS (SELECT * FROM gra WHERE rank <= 24)"


def _graph_lane(spark, d, k=24):
    """``query_id, key, score``: files by the rank of the entities they mention, from the query's nation on."""
    weights = G.edge_weights(V.edges(spark, d), V.NOW)
    seeds = V.asked(spark, d).select("query_id", (101 + F.col("query_id") % 25).cast("long").alias("node"))
    return G.ranked_files_from(weights, seeds, Q.mentions(spark, d), k).select("query_id", "key", "score")


_LANES = f"""{R._TFIDF}, {R._DENSE}, {R._EDGES}, {R._NAMED}, {_GRAPH},
fa AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM lex),
so AS (SELECT query_id, key, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, key, rank FROM fa UNION ALL SELECT query_id, key, rank FROM den UNION ALL SELECT query_id, key, rank FROM gl) GROUP BY ALL),
{R._SPREAD.format("so").replace("rank <= 8", "rank <= 24")},
fu AS (SELECT query_id, key, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, key, rank FROM fa UNION ALL SELECT query_id, key, rank FROM den UNION ALL SELECT query_id, key, rank FROM gl UNION ALL SELECT query_id, key, rank FROM spr UNION ALL SELECT query_id, key, rank FROM named) GROUP BY ALL),
pool AS (SELECT query_id, key, round(score, 10) AS score FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) <= 24),
pt AS (SELECT query_id, key, score, {R._TOK.format("query")} AS qt, regexp_extract_all(lower(coalesce(name, '') || chr(10) || coalesce(description, '') || chr(10) || substr(coalesce(body, ''), 1, 2000)), '[a-z0-9]+') AS tt FROM pool JOIN asked USING (query_id) JOIN docs ON doc_id = key),
rr AS (SELECT query_id, key, score, {R._OVERLAP} AS rerank_score FROM pt),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, key) AS rank FROM rr QUALIFY rank <= 8)"""


def _reranked(spark, d, ranked=None):
    """The fused pool of five lanes, reranked; the pool is max(3k, 20) for k = 8. ``ranked`` is the lexical lane, if it is there already."""
    lexical = (R._lexical(spark, d) if ranked is None else ranked).select("query_id", F.col("doc_id").alias("key"), "score")
    pool = fusion.hybrid_search(lexical, R._dense(spark, d).drop("rank"), _graph_lane(spark, d), R._edges(spark, d), R._names(spark, d), None, 24, rerank=True)
    rows = pool.select("query_id", "key", F.round("score", 10).alias("score")).join(V.asked(spark, d), "query_id")
    return fusion.reranked(rows.join(V.docs(spark, d).select(F.col("doc_id").alias("key"), "name", "description", "body"), "key"))


@CATALOG.query("hybrid_reranked", f"WITH {_LANES} SELECT query_id, key, round(rerank_score, 6) AS rerank_score, round(score, 6) AS score, rank FROM rk")
def hybrid_reranked(spark, d):
    """All five lanes fused, then reranked; the score stays the fused one."""
    return _reranked(spark, d).select("query_id", "key", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"), "rank")


_FLOOR = 0.4


@CATALOG.query("prefetched", f"""WITH {_LANES}, af AS (SELECT * FROM rk WHERE rerank_score >= {_FLOOR}), good AS (SELECT query_id, key, score FROM af WHERE score >= 0.012 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 3),
strong AS (SELECT query_id FROM af GROUP BY query_id HAVING max(score) >= 0.04 UNION SELECT query_id FROM rk GROUP BY query_id HAVING count(*) FILTER (rerank_score >= {_FLOOR}) = 0),
fb AS (SELECT query_id, doc_id AS key, round(score, 10) AS score FROM lex WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM strong))
SELECT query_id, key, round(score, 6) AS score, 'memory' AS layer FROM good UNION ALL SELECT query_id, key, round(score, 6), 'observer' FROM fb""")
def prefetched(spark, d):
    """What a prompt gets: hits above the floor, or the fallback's where they are weak and the floor didn't suppress all."""
    ranked = as_table(R._lexical(spark, d), "lexical")
    before = as_table(_reranked(spark, d, ranked), "reranked")
    after = before.where(F.col("rerank_score") >= _FLOOR)
    fallback = ranked.where("rank <= 3").select("query_id", F.col("doc_id").alias("key"), F.round("score", 10).alias("score"))
    return fusion.prompt_hits(after.select("query_id", "key", "score"), fallback, fusion.floor_outcome(before, after)).withColumn("score", F.round("score", 6))
