"""Fusing ranked lists, and the stages that follow: votes, decay, rerank, floors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table
from mnemoframe.functions.scores import RRF_K
from mnemoframe.operators.lexical import contained_patterns, sized, top_ranked

# Fixed values of the prompt path.
PROMPT_LEAST_CHARS, PROMPT_LEAST_SCORE, PROMPT_MOST_HITS, FALLBACK_BELOW = 10, 0.012, 3, 0.04
STEM_LEAST_CHARS = 6
SPREAD_SEEDS, SPREAD_NEIGHBOURS = 5, 8


def ranked(scored: DataFrame, score: str = "score", key: str = "key", lane: str | None = None) -> DataFrame:
    """``query_id, key, rank`` (from 1) of a scored list, ties by key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 10)), key)
    out = scored.select("query_id", F.col(key).alias("key"), F.row_number().over(order).alias("rank"))
    return out.withColumn("lane", F.lit(lane)) if lane else out


def reciprocal_ranks(lanes: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """``query_id, key, score``: the sum of 1 / (k + rank) over the lists. An empty list has no votes."""
    votes = [lane.select("query_id", "key", "rank") for lane in lanes]
    return reduce(DataFrame.unionByName, votes).groupBy("query_id", "key").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def spread(seeds: DataFrame, edges: DataFrame, per_seed: int = SPREAD_NEIGHBOURS, k: int = 10) -> DataFrame:
    """``query_id, key, score``: what fires together with a query's seeds, seeds left out.

    ``seeds`` has ``query_id, key``, ``edges`` undirected ``a, b, decayed``. Each seed passes on
    to its strongest neighbours, ties by key.
    """
    both = edges.select(F.col("a").alias("seed"), F.col("b").alias("key"), "decayed").unionByName(edges.select(F.col("b").alias("seed"), F.col("a").alias("key"), "decayed"))
    strongest = Window.partitionBy("seed").orderBy(F.desc("decayed"), "key")
    wanted = sized(seeds.select(F.col("key").alias("seed")).distinct())
    near = both.join(wanted, "seed", "left_semi").withColumn("n", F.row_number().over(strongest)).where(F.col("n") <= per_seed)
    reached = seeds.select("query_id", F.col("key").alias("seed")).join(near, "seed").groupBy("query_id", "key").agg(F.sum("decayed").alias("score"))
    fresh = reached.join(seeds, ["query_id", "key"], "left_anti")
    return top_ranked(fresh, k, ["query_id"], [F.desc(F.round("score", 10)), F.col("key")])


def filename_votes(queries: DataFrame, files: DataFrame, key: str = "key", name: str = "filename") -> DataFrame:
    """``query_id, key, rank`` (always 1) for files whose stem of six characters and more is in the query, with ``_`` or spaces.

    A stem counts wherever it stands, also within a longer word. Stems are looked up by their
    grams (:func:`contained_patterns`), so that files times queries never meet. Names are read once.
    """
    stem = F.regexp_replace(F.lower(F.col(name)), r"\.md$", "")
    stems = as_table(files.select(F.col(key).alias("key"), F.translate(stem, "_", " ").alias("pattern")).where(F.length("pattern") >= STEM_LEAST_CHARS), "stems")
    asked = queries.select("query_id", F.translate(F.lower("query"), "_", " ").alias("query"))
    found = as_table(contained_patterns(asked, stems, "query_id", "query"), "named")
    return stems.join(sized(found), "pattern").select("query_id", "key", F.lit(1).alias("rank")).distinct()


def hybrid_search(
    lexical: DataFrame,
    dense: DataFrame,
    graph: DataFrame | None = None,
    edges: DataFrame | None = None,
    named: DataFrame | None = None,
    factors: DataFrame | None = None,
    k: int = 8,
    rerank: bool = False,
) -> DataFrame:
    """``query_id, key, score, rank`` of the fused ranking.

    ``lexical``, ``dense`` and ``graph`` have ``query_id, key, score``, ``named`` comes from
    :func:`filename_votes`, ``edges`` are co-recall edges, ``factors`` has ``key, factor`` of
    decay and corroboration. A query without dense hits keeps its lexical scores as they are,
    unless ``rerank`` follows: then it is fused from what there is. Every lane is computed once, to a table.
    """
    lexical, dense = as_table(lexical, "lane"), as_table(dense, "lane")
    graph, named = (as_table(lane, "lane") if lane is not None else None for lane in (graph, named))
    with_dense = dense.select("query_id").distinct()
    fused_lexical = lexical if rerank else lexical.join(with_dense, "query_id", "left_semi")
    lanes = [ranked(fused_lexical), ranked(dense)]
    if graph is not None:
        lanes.append(ranked(graph if rerank else graph.join(with_dense, "query_id", "left_semi")))
    so_far = reciprocal_ranks(lanes)
    if edges is not None:
        seeds = top_ranked(so_far, SPREAD_SEEDS, ["query_id"], [F.desc(F.round("score", 10)), F.col("key")]).select("query_id", "key")
        lanes.append(spread(seeds, edges, k=k).select("query_id", "key", "rank"))
    if named is not None:
        lanes.append(named if rerank else named.join(with_dense, "query_id", "left_semi"))
    fused = reciprocal_ranks(lanes)
    if factors is not None:
        fused = fused.join(factors, "key", "left").select("query_id", "key", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))
    if not rerank:
        plain = lexical.join(with_dense, "query_id", "left_anti").select("query_id", "key", "score")
        fused = fused.unionByName(plain)
    return top_ranked(fused, k, ["query_id"], [F.desc(F.round("score", 10)), F.col("key")])


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_scorer(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """The default scorer, without a model: the share of the query's tokens that the text holds."""
    import re

    word = re.compile("[a-z0-9]+")
    scores = []
    for q, t in zip(queries, texts):
        asked = set(word.findall((q or "").lower()))
        scores.append(len(asked & set(word.findall((t or "").lower()))) / len(asked) if asked else 0.0)
    return pd.Series(scores, dtype="float64")


def reranked(pool: DataFrame, scorer: Scorer = overlap_scorer, k: int = 8, floor: float | None = None) -> DataFrame:
    """Adds ``rerank_score`` and reorders each query's pool; rows under ``floor`` are left out.

    ``pool`` has ``query_id, key, query, name, description, body, score``. The scorer sees name,
    description and the first 2000 characters of the body. It runs once a batch; an unscored row
    (NaN) stays, after the scored ones, in the order of ``score``, which is kept.
    """
    text = F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 2000))
    score = F.pandas_udf(scorer, "double")
    scored = pool.withColumn("rerank_score", F.nanvl(score("query", text), F.lit(None).cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.desc("score"), "key")
    scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scored if floor is None else scored.where((F.col("rerank_score") >= floor) | F.col("rerank_score").isNull())


def floor_outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """``query_id, candidates, kept, suppressed_all`` of a floor."""
    kept = after.groupBy("query_id").agg(F.count("*").alias("kept"))
    counts = before.groupBy("query_id").agg(F.count("*").alias("candidates")).join(kept, "query_id", "left").fillna(0, ["kept"])
    return counts.withColumn("suppressed_all", (F.col("candidates") > 0) & (F.col("kept") == 0))


def prompt_wanted(prompt: Column | str) -> Column:
    """Whether a prompt is looked up at all: ten characters and more, no command."""
    prompt = F.btrim(F.coalesce(F.col(prompt) if isinstance(prompt, str) else prompt, F.lit("")))
    return (F.length(prompt) >= PROMPT_LEAST_CHARS) & ~F.startswith(prompt, F.lit("/"))


def prompt_hits(hits: DataFrame, fallback: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """``query_id, key, score, layer``: up to three hits of at least the least score, and the fallback's where those are weak.

    The fallback comes where the best hit is under 0.04 or missing and the floor didn't suppress all.
    """
    good = hits.where(F.col("score") >= PROMPT_LEAST_SCORE)
    taken = top_ranked(good.select("query_id", "key", "score"), PROMPT_MOST_HITS, ["query_id"], [F.desc("score"), F.col("key")]).drop("rank")
    strong = hits.groupBy("query_id").agg(F.max("score").alias("top")).where(F.col("top") >= FALLBACK_BELOW).select("query_id")
    if outcomes is not None:
        strong = strong.unionByName(outcomes.where("suppressed_all").select("query_id")).distinct()
    extra = fallback.join(strong, "query_id", "left_anti").select("query_id", "key", "score")
    return taken.withColumn("layer", F.lit("memory")).unionByName(extra.withColumn("layer", F.lit("observer")))


def unified_recall(layers: dict[str, DataFrame]) -> DataFrame:
    """``query_id, layer, key, score, snippet`` of several layers in one table, scores to three places."""
    parts = [df.select("query_id", F.lit(name).alias("layer"), F.col("key").cast("string").alias("key"), F.round("score", 3).alias("score"), "snippet") for name, df in layers.items()]
    return reduce(DataFrame.unionByName, parts)
