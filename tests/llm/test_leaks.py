import random

import pytest

from mnemoframe.llm import leaks
from mnemoframe.llm.leaks import WuManber, item_patterns, leaked_items, words_of


def brute(docs, items, n):
    found = set()
    for d, text in docs:
        joined = " " + " ".join(words_of(text)) + " "
        for i, item in items:
            words = words_of(item)
            windows = [words[k : k + n] for k in range(max(1, len(words) - n + 1))] if words else []
            if any(f" {' '.join(w)} " in joined for w in windows):
                found.add((d, i))
    return found


def test_search_equals_brute_force_on_few_words():
    draw = random.Random(2)
    for _ in range(300):
        patterns = [([draw.choice("ab") for _ in range(draw.randint(1, 5))], k) for k in range(draw.randint(1, 4))]
        text = [draw.choice("abc") for _ in range(draw.randint(0, 30))]
        want = {k for p, k in patterns if any(text[i : i + len(p)] == p for i in range(len(text) - len(p) + 1))}
        assert WuManber(patterns).owners_in(text) == want


@pytest.mark.parametrize("chars", [16_000_000, 60])
def test_leaks_equal_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(leaks, "PATTERN_CHARS", chars)
    draw = random.Random(4)
    items = [(i, " ".join(draw.choice("uvwxyz") for _ in range(draw.choice([2, 5, 9])))) for i in range(12)] + [(50, ""), (51, None), (52, "Ünï-Code 7"), (None, "u v w"), (1, "u v")]
    docs = [(d, "\r\n> ".join(draw.choice("uvwxyz") for _ in range(200))) for d in range(15)] + [(90, None), (91, ""), (92, "see ÜNÏ code_7!"), (93, "x" * 200_000), (94, "ünï code 77")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leaked_items(d, q, 4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, [x for x in items if x[0] is not None], 4)
    assert (92, 52) in got and (94, 52) not in got


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(d, q).collect() == [] and leaked_items(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_patterns_are_windows():
    assert item_patterns([(1, "a b c"), (2, "x"), (3, None)], 2) == [(["a", "b"], 1), (["b", "c"], 1), (["x"], 2)]
