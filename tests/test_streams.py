import pytest
from pyspark.sql import functions as F

from mnemoframe.operators.state import accumulated, debounced
from mnemoframe.streaming import streams as S


@pytest.fixture()
def stores(spark):
    S.use_state_store(spark)


def streamed(spark, tmp_path, rows, ddl, build, parts=2):
    source = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).parquet(source)
    return S.run_to_table(build(stream), str(tmp_path / "out"), str(tmp_path / "cp"))


def test_accumulator_equals_batch(spark, stores, tmp_path):
    rows = [(f"c{i % 3}", i, float(i % 50) if i % 7 else None) for i in range(90)]
    ddl = "category string, seq long, score double"
    got = {tuple(r) for r in streamed(spark, tmp_path, rows, ddl, lambda s: S.accumulating(s, 100), parts=1).collect()}
    assert got == {tuple(r) for r in accumulated(spark.createDataFrame(rows, ddl), "category", "seq", "score", 100).collect()}


def test_debounce_equals_batch(spark, stores, tmp_path):
    rows = [(f"k{i % 2}", float(i * 13 % 500), i) for i in range(60)]
    ddl = "content string, at double, id long"
    got = {tuple(r) for r in streamed(spark, tmp_path, rows, ddl, lambda s: S.debouncing(s, expire=False), parts=1).collect()}
    batch = debounced(spark.createDataFrame(rows, ddl), F.col("content"), "at", "id", F.lit("x"))
    assert got == {tuple(r) for r in batch.collect()}


def test_job_states(spark, stores, tmp_path):
    steps = [("enqueue", 0), ("start", 1), ("fail", 2), ("start", 3), ("tick", 4), ("tick", 9000), ("start", 9001), ("fail", 9002), ("start", 9003), ("fail", 9004), ("start", 9005)]
    rows = [("a", i, action, at) for i, (action, at) in enumerate(steps)] + [("b", 0, "enqueue", 0), ("b", 1, "missing", 1), ("c", 0, "enqueue", 0), ("c", 1, "start", 1), ("c", 2, "succeed", 2), ("c", 3, "fail", 3)]
    out = streamed(spark, tmp_path, rows, "event_id string, seq long, action string, at long", S.job_states, parts=1).collect()
    last = {r["event_id"]: (r["status"], r["attempts"]) for r in sorted(out, key=lambda r: r["seq"])}
    assert last == {"a": ("dead", 3), "b": ("dead", 0), "c": ("done", 1)}
    assert [r["status"] for r in sorted(out, key=lambda r: r["seq"]) if r["event_id"] == "a"][5] == "pending"


def test_sessions_are_abandoned_and_resume(spark, stores, tmp_path):
    rows = [("s", 0, 0, "start"), ("s", 10, 1, "prompt"), ("s", 100_000, 2, "prompt"), ("s", 100_010, 3, "end"), ("t", 5, 0, "start")]
    out = streamed(spark, tmp_path, rows, "session_id string, at long, seq long, action string", S.session_states, parts=1).collect()
    assert [(r["at"], r["status"], r["prompts"]) for r in out if r["session_id"] == "s"] == [(0, "active", 0), (10, "active", 1), (10, "abandoned", 1), (100_000, "active", 2), (100_010, "ended", 2)]


def test_capture_and_deduplication(spark, tmp_path):
    rows = [("a.py", "ls", "x" * 3000), ("a/.env", "cat", "s"), ("b.py", "export TOKEN=1", "AKIA" + "A" * 16), (None, "pwd", None)]
    out = streamed(spark, tmp_path, rows, "path string, cmd string, output string", S.captured).collect()
    got = {r["path"]: (r["cmd"], r["output"], r["output_bytes"]) for r in out}
    assert got == {"a.py": ("ls", "x" * 2000, 2000), "b.py": ("", "[REDACTED]", 10), None: ("pwd", None, None)}


def test_events_once_and_lanes(spark, stores, tmp_path):
    rows = [("2026-01-01 00:00:00", "s", k, p) for k, p in (("write", "1"), ("write", "1"), ("reflect", "2"))]
    build = lambda s: S.deduplicated(S.emitted(s).withColumn("at", F.to_timestamp("timestamp")), "at").select("event_id", "kind")
    out = streamed(spark, tmp_path, rows, "timestamp string, session_id string, kind string, payload string", build)
    assert sorted(r["kind"] for r in out.collect()) == ["reflect", "write"]
    hot, heavy = S.lanes(out, ("reflect",))
    assert (hot.count(), heavy.count()) == (1, 1)
