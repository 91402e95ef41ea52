import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoframe.llm import history
from mnemoframe.llm.history import LEVEL_BITS, LEVELS, TREES, HashForest, depths_for, near_duplicates_of_history, recall_at, repeated_records, words_of


def sets(seed, n):
    """Word sets of 20 to 30 words, many derived from earlier ones by a few changes."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            base = list(draw.choice(out))
            for _ in range(draw.randint(0, 6)):
                base[draw.randrange(len(base))] = f"w{draw.randrange(4000)}"
        else:
            base = [f"w{draw.randrange(4000)}" for _ in range(draw.randint(20, 30))]
        out.append(base)
    return out


def brute(rows, least):
    found = set()
    for i, b, x in rows:
        for j, c, y in rows:
            if None not in (i, j, b, c) and i < j and b != c:
                x_, y_ = set(x.split()), set(y.split())
                if x_ and y_ and len(x_ & y_) / len(x_ | y_) >= least:
                    found.add((i, j))
    return found


def test_near_duplicates_reach_the_recall_and_are_all_true(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(5), " ".join(w)) for i, w in enumerate(sets(1, 400))] + [(900, 1, ""), (901, 2, ""), (902, None, "w1 w2"), (None, 1, "w1")]
    rows += [(950 + i, i % 3, rows[0][2]) for i in range(7)] + rows[:20]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, batch int, text string, class int")
    got = [tuple(r) for r in near_duplicates_of_history(df, "id", "batch", words_of("text"), 0.7).collect()]
    want = brute(list(dict.fromkeys(rows)), 0.7)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 100 and len(set(got)) / len(want) >= 0.99


def test_runs_are_kept_merged_and_found_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FANOUT", 3)
    rows = [(i, " ".join(w)) for i, w in enumerate(sets(2, 150))]
    classes = spark.createDataFrame(rows, "class long, text string").select("class", words_of("text").alias("words")).cache()
    found, largest = set(), 0
    for b in range(10):
        forest = HashForest(spark, "kept", str(tmp_path))  # opened anew for every batch
        own = classes.where(F.col("class") % 10 == b)
        run = forest.append(own, own.count())
        found |= {tuple(r) for r in forest.candidates(run, 0.7).collect()}
        forest.merge()
        largest = max(largest, len(forest.runs()))
    assert sum(r.keys for r in forest.runs()) == 150 * TREES and largest <= 6
    whole = HashForest(spark, "whole", str(tmp_path))
    together = {tuple(r) for r in whole.candidates(whole.append(classes, 150), 0.7).collect()}
    assert found == together and all(a < b for a, b in found)
    whole.drop()
    assert whole.runs() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12), st.lists(st.integers(0, 400), max_size=12), st.sampled_from([1, 3, 1000]))
def test_ranges_widen_to_all_keys_with_a_common_prefix(q, k, most):
    # Keys that differ in the lowest two levels only.
    scale = 1 << LEVEL_BITS
    q, k = np.sort(np.array(q, np.int64) * 40), np.sort(np.array(k, np.int64) * 40)
    old, history.PAIRS_PER_PASS = history.PAIRS_PER_PASS, most
    try:
        got = [(a, b) for i, j in history._located(q, k, [LEVELS, LEVELS - 1, LEVELS - 2]) for a, b in zip(i.tolist(), j.tolist())]
    finally:
        history.PAIRS_PER_PASS = old
    want = {(i, j) for i, x in enumerate(q) for j, y in enumerate(k) if x // scale**2 == y // scale**2}
    assert len(got) == len(set(got)) and set(got) == want


def test_prefixes_are_shortened_until_the_recall():
    assert depths_for(0.7) == [9, 8, 7, 6] and depths_for(0.99) == [9] and depths_for(0.0)[-1] == 1
    for s in (0.5, 0.6, 0.7, 0.9):
        depths = depths_for(s)
        assert recall_at(depths[-1], s) >= history.RECALL and all(recall_at(d, s) < history.RECALL for d in depths[:-1])


def test_repeated_records(spark):
    rows = [(1, 0, "h1", "f1"), (2, 1, "h1", "f1"), (3, 0, "h1", "f1"), (4, 2, None, "f1"), (5, 3, None, "f9"), (6, 4, None, "f9"), (7, 4, None, None), (8, None, "h1", "f1"), (9, 1, "h2", None), (10, 2, "h2", None), (2, 1, "h1", "f1"), (11, 0, "h2", "f2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, batch int, k string, f string, record string")
    got = {tuple(r) for r in repeated_records(df, "id", "batch", F.col("k"), F.col("f")).collect()}
    assert got == {(1, 2), (1, 4), (5, 6), (9, 10)}
    assert repeated_records(df.limit(0), "id", "batch", F.col("k"), F.col("f")).collect() == []
    assert near_duplicates_of_history(df.limit(0), "id", "batch", words_of("k"), 0.7).collect() == []
