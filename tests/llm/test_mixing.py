import random
from fractions import Fraction

import pytest

from mnemoframe.llm import mixing
from mnemoframe.llm.mixing import mix_report, token_count, weighted_mix, with_tokens


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.mark.parametrize("block", [50_000, 7])
def test_shares_repeats_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    draw = random.Random(1)
    rows = [(i, draw.choice(["a"] * 6 + ["b", "c"]), draw.randint(1, 30)) for i in range(300)] + [(1000, None, 5), (1001, "other", 5), (1002, "a", 0), (None, "a", 9)]
    rows.append(rows[0])
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    repeats = {"a": 1, "b": 2, "c": 9}
    mix = weighted_mix(counted(spark, rows), targets(spark, [(f" {s.upper()}", w, repeats[s]) for s, w in shares.items()]))
    got = [tuple(r) for r in mix.collect()]
    assert got == sorted(got)
    held = {}
    for d, s, n in rows:
        if d is not None and s in shares and n > 0 and d not in held:
            held[d] = (s, n)
    total = sum(n for _, n in held.values())
    taken = sum(r[4] for r in got)
    assert total - 30 < taken <= total
    seen = {}
    for _, s, d, k, n in got:
        assert k <= repeats[s] and held[d] == (s, n)
        seen.setdefault((s, d), []).append(k)
    assert all(v == list(range(1, len(v) + 1)) for v in seen.values())
    whole = {s: sum(n for x, n in held.values() if x == s) for s in shares}
    # b runs out at its cap; a and c share what is left by their weights.
    actual = {s: sum(r[4] for r in got if r[1] == s) for s in shares}
    assert actual["b"] <= 2 * whole["b"]
    for s in ("a", "c"):
        assert abs(Fraction(actual[s], 1) / Fraction(shares[s]) - Fraction(actual["a"]) / Fraction(shares["a"])) < 30 / 0.2 + 30 / 0.5
    report = {r["source"]: r for r in mix_report(mix, targets(spark, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("none", 0.0, 1)])).collect()}
    assert {s: r["tokens"] for s, r in report.items()} == {**actual, "none": 0}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_empty_sides_and_budget(spark):
    some = counted(spark, [(1, "a", 5), (2, "a", 7), (2, "a", 7)])
    assert weighted_mix(some.limit(0), targets(spark, [("a", 1.0, 1)])).collect() == []
    assert weighted_mix(some, targets(spark, [("a", float("nan"), 1), ("b", 1.0, 1)])).collect() == []
    assert sum(r["tokens"] for r in weighted_mix(some, targets(spark, [("a", 1.0, None)]), 1_000).collect()) == 12
    assert sum(r["tokens"] for r in weighted_mix(some, targets(spark, [("a", 1.0, 3)]), 30).collect()) <= 30


def test_tokens_round_trip_and_odd_texts(spark):
    encoding = mixing._encoding(mixing.TOKENIZER)
    for text in ("Hello, wörld!\r\n  two", "", "日本語 \U0001f600", "<|endoftext|>"):
        assert encoding.decode(encoding.encode_ordinary(text)) == text
    df = spark.createDataFrame([(1, " A ", None, 1), (2, None, "", 2), (3, "b", "one two", 3)], "doc_id long, source string, text string, tokens int")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in with_tokens(df).collect()}
    assert got == {1: ("a", 0), 2: (None, 0), 3: ("b", token_count("one two"))}
    assert token_count("x" * 50_000) > 0


def test_tokens_of_long_texts_are_those_of_the_whole_text():
    encoding = mixing._encoding(mixing.TOKENIZER)
    draw = random.Random(4)
    parts = ["a", "b", "Z", "9", " ", "  ", "\n", "\r\n", "é", "猫", "'s", "'ll", ".", "!!", "\t", "word ", "\x1c", "\x85"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 80)))
        assert {token_count(text, long=n) for n in (1, 3, 7)} == {len(encoding.encode_ordinary(text))}, repr(text)
    text = "xyz " * 70_000
    assert token_count(text) == len(encoding.encode_ordinary(text))
    assert token_count(" " * 2_000_000 + "\n") > 0


def test_many_repeats_are_only_made_as_far_as_the_budget_goes(spark):
    rows = [(i, "a", 3) for i in range(10)] + [(100 + i, "b", 7) for i in range(5)] + [(3, "b", 9), (3, "a", 8)]
    mix = weighted_mix(counted(spark, rows), targets(spark, [("a", 0.5, 10**9), ("b", 0.5, 1)]), 1_000).collect()
    assert sum(r["tokens"] for r in mix if r["source"] == "b") == 35 and 1_000 - 8 <= sum(r["tokens"] for r in mix) <= 1_000
    assert {(r["source"], r["tokens"]) for r in mix if r["doc_id"] == 3} == {("a", 3)}
