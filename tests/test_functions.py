import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import scores as S
from mnemoframe.functions import text as T
from mnemoframe.functions.names import common_file_name, epoch_day, epoch_second


def values(spark, rows, expr, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(expr).collect()]


def test_file_names(spark):
    assert values(spark, [" /a/B.md\n", "c:\\d\\E.md", "x.md ", "", "a/", None, "　y "], common_file_name("x")) == ["b.md", "e.md", "x.md", None, None, None, "y"]


def test_times(spark):
    assert values(spark, [1_700_000_000_999, 1_700_000_000, 0, -5, None, 10**11], epoch_second("x"), "x long") == [1_700_000_000, 1_700_000_000, None, None, None, 10**11]
    assert values(spark, [86399, 86400], epoch_day("x"), "x long") == [0, 1]


def test_tokens_and_jaccard(spark):
    assert values(spark, ["A-b café 7", None], T.tokens("x")) == [["a", "b", "caf", "7"], []]
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), (None, None)], "p string, q string")
    assert [round(r[0], 4) for r in df.select(T.jaccard(T.word_set("p"), T.word_set("q"))).collect()] == [0.3333, 0.0, 0.0]


def record(subject, predicate, obj, kind):
    def n(x):
        x = x.lower().strip()
        for q in "\"'`‘’“”":
            x = x.replace(q, "")
        return " ".join(x.split(" ")) if "  " not in x else " ".join(x.split())

    core = json.dumps({"subject": n(subject), "predicate": n(predicate), "object": n(obj), "kind": n(kind)}, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(core.encode()).hexdigest()[:32]


@pytest.mark.parametrize("fields", [("A 'b'", "uses", "x\\y", "event"), ("café Zoë", "is", "日本 \U0001f600", "k"), ("  two  spaces ", "p", "o", "k")])
def test_record_hash_is_that_of_python_json(spark, fields):
    df = spark.createDataFrame([fields], "a string, b string, c string, d string")
    assert df.select(T.record_hash("a", "b", "c", "d")).first()[0] == record(*fields)


def test_redaction_of_each_shape(spark):
    secrets = ["sk-" + "a" * 24, "ghp_" + "b" * 32, "AKIA" + "C" * 16, "eyJ" + "d." + "eyJ" + "e.f"]
    assert values(spark, [f"x {s} y" for s in secrets] + ["plain"], T.redacted("x")) == ["x [REDACTED] y"] * 4 + ["plain"]
    assert values(spark, ["export API_KEY=1", "ls", None], T.names_credential("x")) == [True, False, False]


def test_paths(spark):
    rows = ["/a/.env", "x/prod.env.local", "/r/.git/objects/ab/c", "/home/.ssh/id", "a/b/server.pem", "src/main.py", "", None, "C:\\u\\node_modules\\x.js", "/h/.bash_history", "a/credentials.json", "dir.key/x"]
    assert values(spark, rows, T.path_excluded("x")) == [True, True, True, True, True, False, False, False, True, True, True, False]


def test_errors(spark):
    rows = ["ValueError: no", "42: raise ValueError", '{"stderr": "fatal: x", "stdout": ""}', '{"stdout": "ok", "stderr": ""}', "bash: x: Command not found", None, "", "ok\nTraceback (most recent call last)", '{"stdout": "KeyError: k"}', "[1]"]
    assert values(spark, rows, T.looks_like_error("x")) == [True, False, True, False, True, False, False, True, True, False]


def test_small_formats(spark):
    assert values(spark, [7384, 65, 0, None], T.duration("x"), "x long") == ["2h 3m", "1m 5s", "1s", "1s"]
    assert values(spark, ["Fix: the Thing!", "", None], T.slug("x")) == ["fix-the-thing", "candidate", "candidate"]
    assert values(spark, ["a  b\nc", "abcdefghij"], T.one_line("x", 6)) == ["a b c", "abcde…"]
    assert values(spark, ["héé", "abc", None], T.cut_bytes("x", 4)) == ["hé", "abc", None]
    assert values(spark, ["digest_2026-01-31.md", "a_2026_02_03", "2026-13-01", "x"], F.col("x").isNotNull() & T.date_in_name("x").isNotNull()) == [True, True, False, False]
    assert values(spark, ['```json\n{"a": 1}\n```', 'so {"b": 2} there', "none"], T.salvaged_json("x")) == ['{"a": 1}', '{"b": 2}', None]
    assert values(spark, ["# h\n\nFirst one\nmore\n\nSecond", "# only", None], T.first_paragraph(F.coalesce("x", F.lit("")))) == ["First one\nmore", "", ""]
    assert values(spark, ["3 passed", "verified and smoke-tested", "Wrote x.py", "nothing", None, "pytest: verified"], T.verification_verdict("x")) == ["true", "true", "false", "unknown", "unknown", "true"]
    assert values(spark, ["This is a plain sentence about it.", "As an AI I cannot say so.", "{\"a\": 1, \"b\": 22222}", "what is the thing called?", "short"], T.reads_as_document("x")) == [True, False, False, False, False]


def test_scores(spark):
    df = spark.createDataFrame([("HIGH", 0, 3), ("low", None, 0), (None, 1000, 20)], "w string, last long, n int")
    now = 1000 + 180 * 86400
    got = df.select(S.weight_factor("w"), S.recency_boost("last", "n", now), S.decay_factor("last", "w", now)).collect()
    assert [tuple(round(v, 4) for v in r) for r in got] == [(1.3, 1.15, 1.0), (0.9, 1.0, 1.0), (1.0, 1.05, 0.7)]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in v.select(S.cosine("a", "b")).collect()] == [0.7071, 0.0, 0.0]
    assert values(spark, ["2026-06-29", "2026-07-01", "soon", None], S.is_expired("x", 1782777600)) == [True, False, False, False]
    tiers = spark.createDataFrame([(5, 14, 0.5), (5, 14, 0.6), (3, 7, None), (2, 30, 0.1)], "n int, d int, s double")
    assert [r[0] for r in tiers.select(S.confidence_tier("n", "d", "s")).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
