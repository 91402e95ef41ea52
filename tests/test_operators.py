import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import clusters, evaluation, fusion, graph, lexical, logs, state, vectors


def test_gap_windows_across_slices(spark):
    draw = random.Random(1)
    times = sorted(draw.randrange(20_000) for _ in range(150)) + [19_999]
    want, start, before = {}, None, None
    for t in sorted(times):
        if before is None or t - before > 300:
            start = t
        want[t], before = start, t
    df = spark.createDataFrame([(t, "x") for t in times] + [(None, "y")], "ts long, v string")
    got = {r["ts"]: r["window"] for r in logs.gap_windows(df, "ts", 300, slice_seconds=1000).collect()}
    assert got == want


def test_pairs_of_items_and_co_recall(spark):
    rows = [("s", 100, f) for f in "abc"] + [("s", 200, "a"), ("t", 100, "a"), ("t", 100, "b"), ("t", 100, None)]
    df = spark.createDataFrame(rows, "session_id string, ts long, file string")
    got = {(r["a"], r["b"]): (r["weight"], r["last_fired"]) for r in logs.co_recall(df, 100, ["session_id", "ts"]).collect()}
    assert got == {("a", "b"): (2, 100), ("a", "c"): (1, 100), ("b", "c"): (1, 100)}
    only = spark.createDataFrame([("a",), ("b",)], "file string")
    assert logs.co_recall(df, 100, ["session_id", "ts"], valid=only).count() == 1
    assert logs.co_recall(df, 100 + 400 * 86400, ["session_id", "ts"]).count() == 0


def test_error_recovery_by_rows(spark):
    rows = [("s", i, i, "sh", f"run x{i % 2}", i == 1) for i in range(30)] + [("t", 0, 100, "sh", "run", True), ("t", 1, 101, "other", "run", False), ("t", 2, 102, "sh", "walk far", False)]
    df = spark.createDataFrame(rows, "s string, at long, id long, tool string, cmd string, failed boolean")
    assert [tuple(r) for r in logs.error_recoveries(df, "s", "at", "id", "tool", "cmd", F.col("failed")).collect()] == [("s", "sh", 1, 2, 1)]


def test_nearest_in_time_prefers_the_earlier(spark):
    left = spark.createDataFrame([("u", 10, "l1"), ("u", 25, "l2"), ("v", 5, "l3")], "u string, t long, name string")
    right = spark.createDataFrame([("u", 5, "r1"), ("u", 15, "r2"), ("u", 15, "r0"), ("w", 5, "r9")], "u string, t long, k string")
    got = {r["name"]: (r["right_key"], r["gap"]) for r in logs.nearest_in_time(left, right, "t", ["u"], "k").collect()}
    assert got == {"l1": ("r1", 5), "l2": ("r0", 10), "l3": (None, None)}


def test_next_event_over_slices(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(3000), draw.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(rows, "t long, name string")
    got = sorted(((r["at"], r["next_name"], r["next_at"]) for r in logs.next_event(df, "t", "name", F.col("name") == "a", F.col("name") == "b", within=15, slice_seconds=100).collect()), key=str)
    want = sorted(((t, *next(((n2, t2) for t2, n2 in sorted(rows) if n2 == "b" and t <= t2 <= t + 15), (None, None))) for t, n in rows if n == "a"), key=str)
    assert got == want


def test_similar_texts_equal_brute_force(spark):
    draw = random.Random(3)
    texts = [(i, " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 12)))) for i in range(60)] + [(90, None), (91, "")]
    vec = {i: Counter((t or "").split()) for i, t in texts}
    first = {}
    for i, v in sorted(vec.items()):
        first.setdefault(tuple(sorted(v.items())), i)
    reps = sorted(i for k, i in first.items() if k)
    cos = lambda a, b: sum(a[t] * b[t] for t in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    want = {(i, j) for i, j in combinations(reps, 2) if round(cos(vec[i], vec[j]), 12) >= 0.7}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in lexical.similar_texts(df, "doc_id", "text", 0.7).collect()} == want
    with pytest.raises(ValueError):
        lexical.similar_texts(df, "doc_id", "text", 0)


def test_vector_topk_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 2)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0]), (6, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    asked = spark.createDataFrame([(10, [1.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0, 2.0]), (13, [5.0]), (14, None)], "query_id long, vector array<double>")
    got = {}
    for r in vectors.vector_topk(df, asked, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got == {10: [5, 6], 11: [5, 6], 12: [5, 6], 13: [3]}  # a vector is held against those as long as it
    assert vectors.vector_topk(df, asked.limit(0), 2).collect() == []


def test_close_pairs(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.05 * draw.standard_normal(base.shape), base[:3], np.zeros((2, 16))]))]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    got = {(r["a"], r["b"]) for r in vectors.close_pairs(df, 0.92).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if i < 60}
    assert got == {(i, j) for i, j in combinations(unit, 2) if unit[i] @ unit[j] >= 0.92}


def test_hybrid_keeps_lexical_scores_without_dense_hits(spark):
    lex = spark.createDataFrame([(1, "a", 3.5), (1, "b", 2.0), (2, "a", 1.0)], "query_id long, key string, score double")
    dense = spark.createDataFrame([(2, "c", 0.9)], "query_id long, key string, score double")
    got = {(r["query_id"], r["key"]): r["score"] for r in fusion.hybrid_search(lex, dense).collect()}
    assert got == {(1, "a"): 3.5, (1, "b"): 2.0, (2, "a"): 1 / 61, (2, "c"): 1 / 61}
    assert {r["score"] for r in fusion.hybrid_search(lex, dense, rerank=True).where("query_id = 1").collect()} == {1 / 61, 1 / 62}


def test_rerank_floor_and_unscored(spark):
    pool = spark.createDataFrame([(1, k, "red fox", t, "", "", s) for k, t, s in (("a", "fox", 0.9), ("b", "red fox", 0.1), ("c", "cow", 0.5))], "query_id long, key string, query string, name string, description string, body string, score double")
    assert [r["key"] for r in fusion.reranked(pool).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["key"] for r in fusion.reranked(pool, floor=0.5).orderBy("rank").collect()] == ["b", "a"]

    def unsure(q, t):
        return t.map(lambda x: float("nan") if "cow" in x else 0.2)

    assert [r["key"] for r in fusion.reranked(pool, unsure, floor=0.9).collect()] == ["c"]


def test_strict_facts_do_not_come_back(spark):
    rows = [("s", "t", o, i, i) for i, o in enumerate(["A", "B", "A", "A", "s"])]
    df = spark.createDataFrame(rows, "subject string, type string, object string, ts long, seq long")
    loose = sorted((r["valid_from"], r["object"], r["valid_to"]) for r in graph.fact_intervals(df).collect())
    assert loose == [(0, "A", 1), (1, "B", 2), (2, "A", None)]
    assert sorted((r["valid_from"], r["object"], r["valid_to"], r["asserted"]) for r in graph.strict_fact_intervals(df).collect()) == [(0, "A", 1, 3), (1, "B", None, 1)]


def test_chain_with_a_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, None)], "id long, superseded_by long")
    assert {tuple(r) for r in graph.current_rows(df).collect()} == {(1, 3, 2), (2, 3, 1), (3, 3, 0), (4, 4, 0)}
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, superseded_by long")
    assert {(r["id"], r["current"]) for r in graph.current_rows(loop).collect()} == {(1, None), (2, None), (3, 3)}


def test_rank_by_matrix_equals_rank_by_joins_and_leaks(spark):
    weights = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (4, 5, 1.0)], "a long, b long, w double")
    seeds = spark.createDataFrame([("q", 1), ("q", 9), ("r", 5)], "query_id string, node long")
    small = {(r["query_id"], r["node"]): r["rank"] for r in graph.personalised_rank(weights, seeds).collect()}
    large = {(r["query_id"], r["node"]): r["rank"] for r in graph.personalised_rank(weights, seeds, small=0).collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-9 for k in small)
    assert abs(small["q", 9] - 0.075) < 1e-9 and sum(v for (q, _), v in small.items() if q == "q") < 1


def test_sequential_clusterings_depend_on_order(spark, monkeypatch):
    a, b, c = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    assert clusters.greedy_seeds([a, b, c], 0.6) == [0, 0, 2] and clusters.greedy_seeds([b, a, c], 0.6) == [0, 0, 0]
    assert clusters.greedy_centroids([np.array(a), np.array(b), np.array(c)], 0.7) == [0, 0, 2]
    df = spark.createDataFrame([("x", a, 1), ("y", b, 2), ("z", c, 3), ("n", None, 4)], "k string, v array<double>, o int")
    assert {(r["key"], r["cluster"]) for r in clusters.sequential_clusters(df, "k", "v", "o", "seed", 0.6).collect()} == {("x", "x"), ("y", "x"), ("z", "z")}
    monkeypatch.setattr(clusters, "SEQUENTIAL_ROWS", 2)
    with pytest.raises(ValueError):
        clusters.sequential_clusters(df, "k", "v", "o")


def test_upserted_habits_change_the_pool():
    e = np.eye(3)
    assert clusters.upserted_habits([(1, e[0])], [(2, e[0] + 0.1 * e[1]), (3, e[1]), (4, e[1]), (5, 0 * e[2])]) == [(2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True)]


def test_evaluation_of_no_cases(spark):
    cases = spark.createDataFrame([("c", ["x", "y"]), ("d", ["z"])], "id string, expected array<string>")
    hits = spark.createDataFrame([("c", "w", 1), ("c", "y", 2), ("c", "x", 3), ("d", "z", 4)], "id string, key string, rank int")
    got = {r["id"]: (r["passed"], r["rank"], r["matched"]) for r in evaluation.case_results(cases, hits).collect()}
    assert got == {"c": (True, 2, "y"), "d": (False, None, None)}
    assert tuple(evaluation.run_summary(evaluation.case_results(cases, hits)).first()) == (2, 1, 1, 0.5, 0.25)
    assert tuple(evaluation.run_summary(evaluation.case_results(cases.limit(0), hits)).first()) == (0, 0, 0, 0.0, 0.0)


def test_job_log_with_unusable_times(spark):
    rows = [("a", 1, "pending", "x"), ("b", 2, "done", "2020-01-01 00:00:00"), ("c", 3, "done", "soon"), ("a", 4, "done", "2030-01-01 00:00:00"), (None, 5, "done", "")]
    df = spark.createDataFrame(rows, "id string, seq long, status string, updated_at string")
    assert {r["id"] for r in state.compacted_jobs(df, "id", "seq", 1_767_225_600).collect()} == {"a", "c"}
    assert [r["id"] for r in state.read_jobs(df, "id", "seq", limit=2).collect()] == ["a", "b"]
    assert state.consolidation_due(None, 5) and state.consolidation_due(9, 5) and not state.consolidation_due(0, 1739) and state.consolidation_due(0, 1740)


def test_sample_keeps_marked_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    got = sorted(r["n"] for r in logs.systematic_sample(df, ["n"], F.col("n") == 33, 10).collect())
    assert got == [0, 10, 20, 30, 33, 40, 50, 60, 70, 80, 90]
