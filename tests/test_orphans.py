import random

from pyspark.sql import functions as F

from mnemoframe.operators import orphans
from mnemoframe.operators.orphans import orphan_report, reference_status, validity_intervals


def brute(at, key, parents):
    own = [(s, e) for k, s, e in parents if k == key and s is not None and (e is None or e > s)]
    if any(s <= at and (e is None or e > at) for s, e in own):
        return "ok"
    return "missing" if not own else "deleted" if any(s <= at for s, _ in own) else "late"


def run(spark, refs, parents):
    p = validity_intervals(spark.createDataFrame(parents, "k string, s long, e long"), F.col("k"), F.col("s"), F.col("e"))
    return reference_status(spark.createDataFrame(refs, "key string, at long, ref_table string, start string"), p)


def test_status_equals_brute_force_with_and_without_hot_keys(spark, monkeypatch):
    draw = random.Random(5)
    parents = [(f"k{draw.randrange(12)}", draw.randrange(100), draw.choice([None, draw.randrange(140)])) for _ in range(40)] + [(None, 1, 2), ("k1", None, 5), ("k2", 7, 7), ("k3", 4, None), ("k3", 4, None)]
    refs = [(draw.choice(["k3"] * 8 + [f"k{draw.randrange(15)}"]), draw.randrange(150), "t", str(i)) for i in range(400)] + [(None, 3, "t", "x")]
    want = {r[3]: brute(r[1], r[0], parents) for r in refs if r[0] is not None}
    assert {r["start"]: r["status"] for r in run(spark, refs, parents).collect()} == want
    monkeypatch.setattr(orphans, "ROWS_PER_SALT", 20)
    assert {r["start"]: r["status"] for r in run(spark, refs, parents).collect()} == want


def test_ties_in_time_and_empty_sides(spark):
    parents = [("a", 10, 20), ("a", 20, None), ("b", 10, 20)]
    refs = [("a", 20, "t", "1"), ("b", 20, "t", "2"), ("b", 10, "t", "3"), ("b", 9, "t", "4")]
    assert {r["start"]: r["status"] for r in run(spark, refs, parents).collect()} == {"1": "ok", "2": "deleted", "3": "ok", "4": "late"}
    assert {r["status"] for r in run(spark, refs, [("z", 1, None)]).collect()} == {"missing"}
    assert run(spark, refs, parents).limit(0).collect() == []
    empty = spark.createDataFrame([], "k string, s long, e long")
    assert {r["status"] for r in reference_status(spark.createDataFrame(refs, "key string, at long, ref_table string, start string"), validity_intervals(empty, F.col("k"), F.col("s"), F.col("e"))).collect()} == {"missing"}


def test_report_counts_by_month(spark):
    rows = spark.createDataFrame([("t", 0, "ok"), ("t", 1_000_000, "late"), ("u", 2_678_400_000_000, "missing")], "ref_table string, at long, status string")
    got = {(r["ref_table"], r["period"]): (r["n_refs"], r["n_ok"], r["n_missing"], r["n_deleted"], r["n_late"]) for r in orphan_report(rows).collect()}
    assert got == {("t", "1970-01"): (2, 1, 0, 0, 1), ("u", "1970-02"): (1, 0, 1, 0, 0)}
