"""Lanes of the fused search are computed once, seeds that many queries share are ranked once."""

from pyspark.sql import functions as F

from mnemoframe.operators import fusion, graph


def _counting(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_each_lane_is_computed_once(spark):
    lexical, seen = _counting(spark, spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (2, 10, 1.0)], "query_id long, key long, score double"))
    dense, dense_seen = _counting(spark, spark.createDataFrame([(1, 12, 0.5)], "query_id long, key long, score double"))
    edges = spark.createDataFrame([(10, 13, 0.5)], "a long, b long, decayed double")
    got = fusion.hybrid_search(lexical, dense, None, edges, None, None, 5).collect()
    assert {(r["query_id"], r["key"]) for r in got} == {(1, 10), (1, 11), (1, 12), (1, 13), (2, 10)}
    assert (seen.value, dense_seen.value) == (3, 1)


def test_queries_with_the_same_seeds_are_ranked_once(spark, monkeypatch):
    weights = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5)], "a long, b long, w double")
    seeds = spark.createDataFrame([(7, 1), (8, 1), (9, 3), (9, 1), (5, 1)], "query_id long, node long")
    mentions = spark.createDataFrame([(2, 100), (3, 101), (1, 102)], "entity_id long, filename long")
    want = {(r["query_id"], r["key"], round(r["score"], 9), r["rank"]) for r in graph.ranked_files(graph.personalised_rank(weights, seeds), mentions, 2).collect()}
    asked, whole = [], graph.personalised_rank
    monkeypatch.setattr(graph, "personalised_rank", lambda w, s: asked.append(s.select("query_id").distinct().count()) or whole(w, s))
    got = graph.ranked_files_from(weights, seeds, mentions, 2).select("query_id", "key", F.round("score", 9), "rank").collect()
    assert {tuple(r) for r in got} == want and asked == [2]
