"""Close vectors without a row per vector and table of buckets."""

import numpy as np

from mnemoframe.operators import clusters, vectors


def test_only_close_pairs_leave_the_buckets(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((60, 12))
    rows = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.05 * draw.standard_normal(base.shape), base[:4], np.zeros((2, 12)), [[0.0] * 11 + [-0.0]]]))] + [("n", None), (None, [1.0] * 12), ("short", [1.0, 2.0]), ("tall", [2.0, 4.0])]
    df = spark.createDataFrame(rows, "key string, vector array<double>").repartition(3)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:120]}
    keys = sorted(unit)
    want = {(a, b) for a in keys for b in keys if a < b and unit[a] @ unit[b] >= 0.92} | {("short", "tall")}
    monkeypatch.setattr(vectors, "SKETCHES_PER_TASK", 50)  # several parts of each table
    monkeypatch.setattr(vectors, "PAIRS_PER_BLOCK", 7)
    written = {}
    kept = vectors.as_table
    monkeypatch.setattr(vectors, "as_table", lambda d, name, **kw: written.setdefault(name, kept(d, name, **kw)))
    got = [(r["a"], r["b"]) for r in vectors.close_pairs(df, 0.92).collect()]
    assert set(got) == want and len(got) == len(want)
    # Every pair of a bucket was shuffled before, and every vector 64 times.
    assert written["met"].count() < 2 * len(want) and written["met"].distinct().count() == written["met"].count()
    files = spark.createDataFrame([("k000", ["k060"])], "key string, related array<string>")
    copies = {(f"k{i:03d}", f"k{i + 120:03d}") for i in range(4)} | {("k124", "k125"), ("k124", "k126")}
    near = {(r["a"], r["b"]): r["intended"] for r in clusters.near_duplicates(df, files).collect()}
    assert set(near) == want | copies and near["k000", "k060"] and not near["k001", "k061"]
