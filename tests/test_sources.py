import os

import pytest
from pyspark.sql import functions as F

from mnemoframe.sources import readers as R
from mnemoframe.sources import writers as W

NOTE = "---\nname: Ledger\nrelated: a.md,  b.md ,\ntype: project\nname: Ledger two\nno colon here\nexpires: 2026-01-01\nurl: http://x:8\n---\n\nBody line\n---\nmore\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"one.md": NOTE, "bare.md": "just text", "MEMORY.md": "index", "sub/deep.md": "x", "empty.md": "", "skip.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_memories_of_a_folder(spark, folder):
    rows = {r["filename"]: r for r in R.read_memories(spark, folder).collect()}
    assert set(rows) == {"one.md", "bare.md"}
    one = rows["one.md"]
    assert (one["name"], one["type"], one["related"], one["expires"], one["created"]) == ("Ledger two", "project", ["a.md", "b.md"], "2026-01-01", None)
    assert one["raw_frontmatter"]["url"] == "http://x:8" and one["body"] == "Body line\n---\nmore\n"  # white space after the second mark is part of it
    assert (rows["bare.md"]["name"], rows["bare.md"]["body"], rows["bare.md"]["raw_frontmatter"]) == ("bare", "just text", {})
    assert abs(one["mtime"] - os.path.getmtime(f"{folder}/one.md")) < 1
    assert {r["filename"] for r in R.read_texts(spark, folder, recursive=True).collect()} == {"one.md", "bare.md", "MEMORY.md", "deep.md"}


def test_strict_header(spark):
    df = spark.createDataFrame([("---\nname: \"Q\"\n1bad: x\nok_2 : 'y'\n---\nz",)], "content string")
    assert df.select(R.front_matter("content", True)).first()[0] == {"name": "Q", "ok_2": "y"}


def test_json_lines_with_torn_ones(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n[1]\n{"a": 2\n\n{"a": 3, "b": "x"}\n')
    good, torn = R.read_json_lines(spark, str(tmp_path / "log.jsonl"), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, None), (3, "x")]
    assert sorted(r["value"] for r in torn.collect()) == ['[1]', '{"a": 2']


def test_index(spark):
    text = "# Index\n- [Title](x.md) — what it is\n- `y.md` : second\n- [Again](x.md)\nnothing\n- [L](z.md) and `w.md`"
    rows = [(r["title"], r["filename"], r["description"]) for r in R.index_entries(spark.createDataFrame([(text,)], "content string")).orderBy("line").collect()]
    assert rows == [("Title", "x.md", "what it is"), ("y.md", "y.md", "second"), ("L", "z.md", "and `w.md`")]


def test_sections(spark):
    text = "intro\n## What we BUILT / did\nline 1\n\n### part\nline 2\n## Other\nkept\n## what mattered most\n\n## Open threads\n x \n"
    got = {(r["section"], r["text"]) for r in R.sections(spark.createDataFrame([("k", text)], "name string, content string"), "name").collect()}
    assert got == {("What we built / did", "line 1\n\n### part\nline 2\n## Other\nkept"), ("Open threads", "x")}


def test_threads_probes_candidates(spark):
    text = "# Open\n- [ ] t1 — fix — this _(opened 2026-01-02)_\n- [x] t22 — done\n- [ ] bad — no"
    got = [tuple(r) for r in R.threads(spark.createDataFrame([("k", text)], "k string, content string"), "k").collect()]
    assert got == [("k", "t1", False, "fix — this", "2026-01-02"), ("k", "t22", True, "done", None)]
    probe = "---\ndate: 2026-02-03\nprobe_type: daily\nresult: ok\n---\n## Response here\n\n```text\nI am\nthere\n```\n"
    assert tuple(R.probes(spark.createDataFrame([("p1.md", probe)], "filename string, content string")).first()) == ("p1", "2026-02-03", "daily", "ok", "I am\nthere")
    cand = "source_obs_ids: [1, 2]\ncluster_score: 0.75\ngenerated_at: 99\nsource_session: s1\n## Topic\nledger work\n## Recommended memory file\n`l.md`\n## Files involved\n- `a.py`\n"
    df = spark.createDataFrame([("c/1.md", cand), ("c/2.md", "no ids"), ("c/3.md", cand.replace("[1, 2]", "[1, x]"))], "path string, content string")
    rows = R.candidates(df).collect()
    assert [(r["path"], r["obs_ids"], r["recommended"], r["cluster_score"], r["generated_at"], r["topic"], r["top_file"]) for r in rows] == [("c/1.md", [1, 2], "l.md", 0.75, 99, "ledger work", "a.py")]
    paths = spark.createDataFrame([("a/b.md",), ("a/archived/c.md",), ("a/archived.md",)], "path string")
    assert sorted(r[0] for r in R.pending(paths).collect()) == ["a/archived.md", "a/b.md"]


def test_payloads(spark):
    df = spark.createDataFrame([('{"session_id": "", "sessionId": "s", "tool_name": "Read"}',), ("torn",)], "raw string")
    got = [r[0].asDict() for r in df.select(R.hook_payload("raw", {"session": ("session_id", "sessionId"), "tool": ("tool_name", "toolName")})).collect()]
    assert got == [{"session": "s", "tool": "Read"}, {"session": None, "tool": None}]
    inputs = spark.createDataFrame([('{"file_path": "a", "files": ["b", "a", ""], "edits": [{"file_path": "c"}]}',), ("{}",)], "x string")
    assert [r[0] for r in inputs.select(R.tool_paths("x")).collect()] == [["a", "b", "c"], []]


def test_text_edits(spark):
    one = lambda expr, text: spark.createDataFrame([(text,)], "t string").select(expr).first()[0]
    links = F.array(F.lit("b.md"), F.lit("c.md"))
    assert one(W.with_related("t", links), "---\nname: x\nrelated: a.md, b.md\n---\nbody") == "---\nname: x\nrelated: a.md, b.md, c.md\n---\nbody"
    assert one(W.with_related("t", links), "---\nname: x\n---\nbody") == "---\nname: x\nrelated: b.md, c.md\n---\nbody"
    assert one(W.with_related("t", links), "plain") == "plain"
    assert one(W.bumped("t", "2026-02-02"), "---\nname: x\ncorroborations: 2\nlast_corroborated: 2025-01-01\n---\nb") == "---\nname: x\ncorroborations: 3\nlast_corroborated: 2026-02-02\n---\nb"
    block = F.lit("new")
    first = one(W.spliced("t", block), "head")
    assert first == f"head\n\n---\n\n{W.MARK_START}\nnew\n{W.MARK_END}\n"
    assert one(W.spliced("t", F.lit("newer")), first + "tail") == f"head\n\n---\n\n{W.MARK_START}\nnewer\n{W.MARK_END}\ntail"


def test_index_render(spark):
    df = spark.createDataFrame([("self_a.md", "A", "says\na", "", "high"), ("x.md", "X", "", "project", ""), ("y.md", "Y", None, None, None)], "filename string, name string, description string, type string, weight string")
    text = W.rendered_index(df, "now")
    assert "**Total memories indexed:** 3" in text and "- `self_a.md` — says a  *[weight: high]*" in text
    assert text.index("Self (") < text.index("### Projects (1)") < text.index("### Untyped (1)")


def test_graduation_names(spark):
    cand = spark.createDataFrame([("p1", [1], 1, "Ledger!", 0.9), ("p2", [2], 2, "ledger", 0.8), ("p3", [3], 3, "ledger", 0.1), ("p4", [4], 4, "(no clear topic)", 0.9)], "path string, obs_ids array<bigint>, generated_at long, topic string, cluster_score double")
    taken = spark.createDataFrame([("session_ledger.md",)], "filename string")
    assert {r["path"]: r["filename"] for r in W.graduations(cand, taken, 0.5).collect()} == {"p1": "session_ledger_2.md", "p2": "session_ledger_3.md", "p3": None, "p4": None}


def test_migrations_run_once(spark, tmp_path):
    log, ran = str(tmp_path / "log"), []
    steps = [("one", lambda: ran.append(1) or 3), ("two", lambda: ran.append(2) or 0)]
    assert W.migrate(spark, log, steps[:1]) == ["one"] and W.migrate(spark, log, steps) == ["two"] and W.migrate(spark, log, steps) == []
    assert ran == [1, 2]
    assert W.with_columns(spark.range(1), {"id": "int", "x": "string"}).columns == ["id", "x"]


def test_append_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "t")
    W.append(spark.range(3).withColumn("d", F.lit("x")), path, ["d"])
    W.append(spark.range(2).withColumn("d", F.lit("y")), path, ["d"])
    assert spark.read.parquet(path).count() == 5
    W.rebuild(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1
    seeds = R.first_json(spark, [str(tmp_path / "none.json"), str(tmp_path / "nor.json")], "a int")
    assert seeds.collect() == [] and seeds.columns == ["a"]
