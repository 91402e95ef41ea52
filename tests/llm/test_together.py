import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from mnemoframe.llm import together
from mnemoframe.llm.together import BinaryBlock, items_together


def brute(rows, least, ratio):
    baskets = {}
    for b, t, i in rows:
        if b is not None and t is not None and i is not None:
            baskets.setdefault((b, t), set()).add(i)
    single = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    n = len(baskets)
    return {(a, b, c, single[a], single[b], n) for (a, b), c in both.items() if c >= least and c * n >= ratio * single[a] * single[b]}


@pytest.mark.parametrize("block", [1024, 4])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(together, "BLOCK_ITEMS", block)
    monkeypatch.setattr(together, "PRODUCTS_PER_PASS", 50 if block == 4 else 2_000_000)
    draw = random.Random(6)
    rows = [(f"s{draw.randrange(9)}", draw.randrange(6), draw.choice(["hot", *"abcdefghijklmnop"])) for _ in range(400)]
    rows += [("big", 1, f"i{k}") for k in range(60)] + [("big", 2, f"i{k}") for k in range(60)] + [("big", 3, f"i{k}") for k in range(0, 60, 2)]
    rows += [(None, 1, "a"), ("s1", None, "a"), ("s1", 1, None), ("alone", 1, "only")] + rows[:50]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "code string, part int, item string, a int, n int")
    for least, ratio in ((2, 0.5), (3, 1.5)):
        got = [tuple(r)[:6] for r in items_together(df, ["code", "part"], "item", least, ratio).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, least, ratio)


def test_no_rows_and_a_single_basket(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b")], "s string, t int, i string")
    assert [tuple(r) for r in items_together(df, ["s", "t"], "i", 1, 0.0).collect()] == [("a", "b", 1, 1, 1, 1, 1.0)]
    assert items_together(df.limit(0), ["s", "t"], "i").collect() == []


def test_products_of_sparse_blocks():
    draw = np.random.default_rng(8)
    for dense in (10**6, 0):
        together.DENSE_CELLS, before = dense, together.DENSE_CELLS
        try:
            x, y = (draw.random((9, w)) < 0.4 for w in (7, 5))
            as_block = lambda m, base: BinaryBlock(np.nonzero(m)[1] * 10 + base, m.sum(axis=1))
            a, b = as_block(x, 0), as_block(y, 1000)
            whole = lambda cells: {(i, j): n for i, j, n in zip(*(c.tolist() for c in cells))}
            want = x.T.astype(int) @ x
            assert whole(a.gram()) == {(i * 10, j * 10): want[i, j] for i in range(7) for j in range(i + 1, 7) if want[i, j]}
            want = x.T.astype(int) @ y
            assert whole(a.times(b)) == {(i * 10, j * 10 + 1000): want[i, j] for i in range(7) for j in range(5) if want[i, j]}
        finally:
            together.DENSE_CELLS = before


def test_a_basket_of_ten_thousand_items(spark):
    n = 10_000
    rows = [("huge", i) for i in range(n)] + [("pair", 1), ("pair", 2)] + [("other", i) for i in range(0, n, 100)]
    df = spark.createDataFrame(rows, "b string, i long")
    got = {tuple(r)[:3] for r in items_together(df, ["b"], "i", 2, 0.0).collect()}
    twice = sorted(str(i) for i in {*range(0, n, 100), 1, 2})
    hundred = {str(i) for i in range(0, n, 100)}
    assert got == {(a, b, 2) for a in twice for b in twice if a < b and ({a, b} <= hundred or {a, b} == {"1", "2"})}
    # Every item is kept here: the whole basket is multiplied part by part.
    assert items_together(df.where("b = 'huge' AND i < 3000"), ["b"], "i", 1, 0.0).count() == 3000 * 2999 // 2
