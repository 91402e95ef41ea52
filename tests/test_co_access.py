"""The most frequent pairs of gap windows."""

from collections import Counter
from itertools import combinations

from mnemoframe.operators import logs


def _counted(rows, gap=600):
    counts, window, last = Counter(), set(), None
    for t, f in sorted(rows) + [(1 << 40, None)]:
        if last is not None and t - last > gap:
            counts.update(combinations(sorted(window), 2))
            window = set()
        window.add(f)
        last = t
    return counts


def test_pairs_that_cannot_be_among_the_best_are_not_counted(spark, monkeypatch):
    # Two hundred files in the same four windows, others in fewer or other ones: before, each window unfolded all its pairs.
    rows = [(10_000 * w, f"f{i:03}") for w in range(4) for i in range(200)]
    rows += [(10_000 * w, f"a{i}") for w in range(4, 10) for i in range(w, 12)] + [(10_000 * w, "f150") for w in range(4, 7)]
    unfolded = []
    whole = logs.item_pairs
    monkeypatch.setattr(logs, "item_pairs", lambda *a: unfolded.append(whole(*a)) or unfolded[-1])
    df = spark.createDataFrame([(f, t) for t, f in rows] + [(None, 5)], "file string, ts long")
    for k, least in ((20, 3), (3, 1), (40, 4), (500, 3)):
        unfolded.clear()
        got = [tuple(r) for r in logs.co_access(df, k=k, least=least).orderBy(logs.F.desc("n"), "a", "b").collect()]
        counts = sorted(((a, b, n) for (a, b), n in _counted(rows).items()), key=lambda x: (-x[2], x[0], x[1]))[:k]
        assert got == [x for x in counts if x[2] >= least]
        if k <= 20:
            assert sum(x.count() for x in unfolded) < 20_000
    assert logs.co_access(df.limit(0)).collect() == []
