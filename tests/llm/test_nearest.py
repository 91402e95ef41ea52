import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import nearest
from mnemoframe.llm.nearest import latest_vectors, nearest_vectors


def brute(rows, k):
    out = {}
    for i, m, v in rows:
        if i is None or m is None:
            continue
        scored = []
        for j, o, w in rows:
            if j is not None and o == m and j != i:
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                s = 1.0 if np.array_equal(a, b) else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
                scored.append((-round(s, 12), j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centers = draw.standard_normal((max(2, n // 25), dim))
    return [(centers[draw.integers(len(centers))] + 0.6 * draw.standard_normal(dim)).astype(np.float32).tolist() for _ in range(n)]


def test_all_lists_are_exact_where_every_cell_is_visited(spark):
    vectors = clustered(120, 7, 1)
    rows = [(f"f{i:03d}", "m", v) for i, v in enumerate(vectors)] + [(f"copy{i}", "m", vectors[3]) for i in range(9)] + [("alone", "x", [1.0, 2.0]), (None, "m", vectors[0]), ("nomodel", None, vectors[0])]
    df = spark.createDataFrame([(*r, "c", 9) for r in rows], "id string, model string, vector array<float>, other string, rank int").select("id", "model", "vector", "other", "rank")
    got = {}
    for r in nearest_vectors(df, "id", "model", "vector", 4, candidates=10_000).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["similarity"]))
    want = {i: v for i, v in brute(rows, 4).items() if v}
    assert got.keys() == want.keys()
    for i, v in want.items():
        assert [x for x, _ in got[i]] == [x for x, _ in v], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in v])


@pytest.mark.parametrize("shard", [1000, 40])
def test_recall_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(nearest, "ROWS_PER_SHARD", shard)
    monkeypatch.setattr(nearest, "LEAST_ROWS", 100)
    rows = [(f"f{i:04d}", "m", v) for i, v in enumerate(clustered(900, 24, 2))]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    found = {(r["id"], r["other"]) for r in nearest_vectors(df, "id", "model", "vector", 5, candidates=120).collect()}
    want = {(i, j) for i, v in brute(rows, 5).items() for j, _ in v}
    assert len(found & want) / len(want) >= 0.9


def test_unusable_vectors_and_versions(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, "m", 2, [1.0, 0.0]), ("a", 2.0, "m", 2, [0.0, 1.0]), ("b", 1.0, "m", 2, [1.0]), ("c", 1.0, "m", 2, [0.0, 0.0]), ("d", 1.0, "m", 2, [nan, 1.0]), ("e", 1.0, "m", 2, [inf, 1.0]), ("f", 1.0, "m", 2, None), ("g", 1.0, "m", 2, [1.0, 2.0]), ("g", 3.0, "m", 2, None), ("h", None, "m", 2, [3.0, 4.0]), ("i", 1.0, "m", None, [3.0, 4.0]), ("j", 1.0, "m", 2, [1.0, None])]
    df = spark.createDataFrame(rows, "id string, mtime double, model string, dim int, vector array<float>")
    assert {(r["id"], tuple(r["vector"])) for r in latest_vectors(df, F.col("id")).collect()} == {("a", (0.0, 1.0)), ("h", (3.0, 4.0))}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", [1.0, 1e-3]), ("c", "one", [5.0])], "id string, model string, vector array<float>")
    assert {(r["id"], r["other"], r["rank"]) for r in nearest_vectors(df, "id", "model", "vector").collect()} == {("a", "b", 1), ("b", "a", 1)}
    assert nearest_vectors(df.limit(0), "id", "model", "vector").collect() == []


def test_traversal_visits_cells_by_summed_distance(monkeypatch):
    draw = np.random.default_rng(5)
    index = nearest.MultiIndex(np.zeros((9, 1), np.float32), np.zeros((7, 1), np.float32))
    index.divide(draw.integers(0, 3, 63))
    a, b = draw.random((40, 9)).astype(np.float32), draw.random((40, 7)).astype(np.float32)
    for most in (10, 8192):
        monkeypatch.setattr(nearest, "SORTED_CELLS", most)
        for n in (1, 4, 20, 1000):
            query, cell = index.traverse_all(a, b, n)
            for q in range(40):
                order = np.argsort((a[q][:, None] + b[q][None, :]).ravel(), kind="stable")
                upto = np.cumsum(index.sizes[order])
                want = {c for c, s in zip(order.tolist(), (upto - index.sizes[order]).tolist()) if s < n and index.sizes[c]}
                assert set(index.traverse(a[q], b[q], n)) == want == set(cell[query == q].tolist())


def test_ties_go_by_id_over_scaled_vectors_and_different_directions(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST_ROWS", 4)
    monkeypatch.setattr(nearest, "ROWS_PER_SHARD", 3)
    direction = [0.25, -1.0, 0.5, 3.0]
    rows = [(f"s{i:02d}", "m", [x * 2.0**e for x in direction]) for i, e in enumerate(range(-15, 15))]
    # Eight directions with equal cosines to "z": signs of the last three.
    rows += [("z", "x", [1.0, 0.0, 0.0, 0.0])] + [(f"t{i}", "x", [1.0, *((1.0 if i >> j & 1 else -1.0) for j in range(3))]) for i in (5, 2, 7, 0, 6, 1, 4, 3)]
    rows += [("short", "x", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    got = {}
    for r in nearest_vectors(df, "id", "model", "vector", 5, candidates=10_000).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    names = [f"s{i:02d}" for i in range(30)]
    assert all(got[n] == [x for x in names if x != n][:5] for n in names)
    assert got["z"] == ["t0", "t1", "t2", "t3", "t4"] and "short" not in got


def test_a_cell_larger_than_a_shard_is_split(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_SHARD", 10)
    monkeypatch.setattr(nearest, "LEAST_ROWS", 10)
    draw = np.random.default_rng(3)
    rows = [(f"f{i:03d}", "m", (np.ones(6) + 1e-3 * draw.standard_normal(6)).astype(np.float32).tolist()) for i in range(150)] + [(f"g{i:03d}", "m", draw.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    found = {(r["id"], r["other"]) for r in nearest_vectors(df, "id", "model", "vector", 3, candidates=10_000).collect()}
    assert found == {(i, j) for i, v in brute(rows, 3).items() for j, _ in v}


def test_loss_is_measured_against_the_exact_lists(spark):
    rows = [(f"f{i:03d}", "m", v) for i, v in enumerate(clustered(80, 5, 4))] + [("one", "x", [1.0])]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    found = nearest_vectors(df, "id", "model", "vector", 3)
    whole = nearest.measured_loss(df, found, "id", "model", "vector", 3, every=1, most=7).first()
    assert (whole["asked"], whole["wanted"], whole["found"], whole["loss"]) == (80, 240, 240, 0.0)
    part = nearest.measured_loss(df, found.where("rank < 3"), "id", "model", "vector", 3, every=1).first()
    assert part["found"] == 160 and abs(part["recall"] - 2 / 3) < 1e-12
    assert nearest.measured_loss(df.limit(0), found, "id", "model", "vector", 3).first()["recall"] is None


def test_queries_in_passes_find_the_same(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"f{i:04d}", "m", draw.standard_normal(16).round(3).tolist()) for i in range(1500)], "id string, model string, vector array<float>").repartition(3)
    want = {(r["id"], r["other"], r["rank"]) for r in nearest.nearest_vectors(rows, "id", "model", "vector").collect()}
    sizes = []

    monkeypatch.setattr(nearest, "PASS_BYTES", 1)
    monkeypatch.setattr(nearest, "PASS_SHARE", 0.4)
    real = nearest.passes_for
    monkeypatch.setattr(nearest, "passes_for", lambda *a: sizes.append(real(*a)) or sizes[-1])
    got = nearest.nearest_vectors(rows, "id", "model", "vector")
    assert {(r["id"], r["other"], r["rank"]) for r in got.collect()} == want and len(want) == 7500
    assert sizes and sizes[0] > 1  # all queries went at once before


def test_a_pass_moves_a_bounded_share():
    # 12 shards a query: all at once that was 12 times the vectors.
    n, size = 8_600_000, 512
    passes = nearest.passes_for(12, n, size)
    assert passes == 4 and 12 * n * size / passes <= nearest.PASS_SHARE * n * size
    assert nearest.passes_for(12, 1000, size) == 1 and nearest.passes_for(0, 0, 0) == 1


def test_queries_are_not_shuffled_to_the_cells_they_visit(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST_ROWS", 100)
    monkeypatch.setattr(nearest, "ROWS_PER_SHARD", 60)
    plans, real = {}, nearest.as_table

    def kept(df, name="cut", *rest, **named):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, *rest, **named)

    monkeypatch.setattr(nearest, "as_table", kept)
    rows = [(f"f{i:03d}", "m" if i % 5 else "n", v) for i, v in enumerate(clustered(400, 12, 6))]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    found = {(r["id"], r["other"]) for r in nearest_vectors(df, "id", "model", "vector", 4, candidates=10_000).collect()}
    assert found == {(i, j) for i, v in brute(rows, 4).items() for j, _ in v}
    assert "Repartition" not in plans["nearest"] and "Window" not in plans["nearest"]  # each query went to every shard that it visits before


def test_many_cells_need_no_heap_for_each_query(monkeypatch):
    monkeypatch.setattr(nearest, "SORTED_CELLS", 100)
    monkeypatch.setattr(nearest.MultiIndex, "traverse", None)  # it was called for each query before
    draw = np.random.default_rng(8)
    index = nearest.MultiIndex(np.zeros((70, 1), np.float32), np.zeros((50, 1), np.float32))
    index.divide(draw.integers(0, 3, 3500) * (draw.random(3500) < 0.2))
    a, b = draw.random((30, 70)).astype(np.float32) ** 2, draw.random((30, 50)).astype(np.float32) * 3
    for n in (1, 40, 400, 5000):
        query, cell = index.traverse_all(a, b, n)
        for q in range(30):
            order = np.argsort((a[q][:, None].astype(float) + b[q][None, :]).ravel(), kind="stable")
            upto = np.cumsum(index.sizes[order])
            want = {c for c, s in zip(order.tolist(), (upto - index.sizes[order]).tolist()) if s < n and index.sizes[c]}
            assert want == set(cell[query == q].tolist())


def test_huge_and_tiny_vectors_have_their_neighbours(spark):
    draw = np.random.default_rng(9)
    rows = [(f"f{i:02d}", "m", (draw.standard_normal(5) * 10.0 ** draw.integers(-30, 30)).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>")
    found = {(r["id"], r["other"]) for r in nearest_vectors(df, "id", "model", "vector", 3).collect()}
    assert found == {(i, j) for i, v in brute(rows, 3).items() for j, _ in v}
