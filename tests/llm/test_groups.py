import random

import pytest

from mnemoframe.llm.groups import connected_groups


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return {(min(g), x) for g in groups.values() for x in g}


CASES = {
    "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)],
    "shuffled chain": [(f"{(i * 37) % 97:02d}", f"{((i + 1) * 37) % 97:02d}") for i in range(96)],
    "star around the last": [("zz", f"a{i}") for i in range(40)],
    "nulls, loops, repeats": [("a", "a"), (None, "b"), ("b", None), ("c", "d"), ("d", "c"), ("c", "d")],
    "random": [(str(random.Random(i).randrange(60)), str(random.Random(i + 1000).randrange(60))) for i in range(45)],
    "nothing": [],
}


@pytest.mark.parametrize("name", CASES)
def test_groups_equal_union_find(spark, name):
    df = spark.createDataFrame(CASES[name], "a string, b string")
    assert {(r["group"], r["member"]) for r in connected_groups(df).collect()} == brute(CASES[name])


def test_other_columns_may_have_the_same_names(spark):
    df = spark.createDataFrame([("x", "y", 1, 2, "g")], "a string, b string, id int, label int, `group` string")
    assert {tuple(r) for r in connected_groups(df).collect()} == {("x", "x"), ("x", "y")}
