import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.operators import rolling
from mnemoframe.operators.rolling import doubled_sums, rolling_totals


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=80), st.lists(st.integers(1, 40), min_size=1, max_size=4))
def test_doubling_equals_plain_sums(cells, windows):
    got = doubled_sums(np.array(cells, np.int64), windows)
    for w in windows:
        assert got[w].tolist() == [sum(cells[max(0, i - w + 1) : i + 1]) for i in range(len(cells))]


def test_windows_must_be_positive():
    with pytest.raises(ValueError):
        doubled_sums(np.zeros(3), [0])


def brute(rows, windows, last):
    days = defaultdict(lambda: defaultdict(int))
    for key, day in rows:
        if key is not None and day is not None:
            days[key][day] += 1
    return {(k, d): (v.get(d, 0), *[sum(v.get(x, 0) for x in range(d - w + 1, d + 1)) for w in windows]) for k, v in days.items() for d in range(min(v), last + 1)}


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_rolling_totals_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(rolling, "CELLS_PER_PASS", cells)
    draw = np.random.default_rng(3)
    rows = [(f"k{draw.integers(5)}", int(draw.integers(100, 220))) for _ in range(300)] + [("lone", 100), ("late", 219), (None, 150), ("k1", None)]
    df = spark.createDataFrame(rows, "key string, total int").withColumnRenamed("total", "day")
    want = brute(rows, (7, 30), 219)
    got = {(r["key"], (r["day"] - dt.date(1970, 1, 1)).days): (r["total"], r["total_7"], r["total_30"]) for r in rolling_totals(df, "key", "day").collect()}
    assert got == want
    active = {(r["key"], (r["day"] - dt.date(1970, 1, 1)).days): (r["total"], r["total_7"], r["total_30"]) for r in rolling_totals(df, "key", "day", every_day=False).collect()}
    assert active == {k: v for k, v in want.items() if v[2]}


def test_values_nulls_and_empty_input(spark):
    df = spark.createDataFrame([("a", 10, 1.5), ("a", 10, None), ("a", 12, 2.0)], "key string, day int, v double")
    got = {(r["day"] - dt.date(1970, 1, 1)).days: (r["total"], r["total_2"]) for r in rolling_totals(df, "key", "day", "v", (2,)).collect()}
    assert got == {10: (1.5, 1.5), 11: (0.0, 1.5), 12: (2.0, 2.0)}
    assert rolling_totals(df.limit(0), "key", "day").collect() == []
    assert rolling_totals(df, "key", "day", last_day=9).collect() == []
