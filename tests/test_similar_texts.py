"""All pairs of texts in blocks, without a row per pair and term."""

import random
from collections import Counter
from itertools import combinations
from math import sqrt

from mnemoframe.operators import lexical


def test_blocks_have_every_pair_and_shuffle_none(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 14))) for _ in range(90)]
    texts[7], texts[8], texts[9], texts[40], texts[50] = "", None, "W1 w1-W2", "w2 w1 w1", " ".join(["w3"] * 5000)  # 9 and 40 have equal counts; 5000 * 5000 is beyond 2^24
    texts[51] = " ".join(["w3"] * 4999 + ["w4"] * 3)
    df = spark.createDataFrame([*enumerate(texts), (3, "w1 w24"), (None, "w1")], "doc_id long, text string").repartition(3)
    whole = {i: Counter((t or "").lower().replace("-", " ").split()) for i, t in enumerate(texts)}
    whole[3].update(["w1", "w24"])  # a key's texts are one
    norm = {i: sqrt(sum(n * n for n in c.values())) for i, c in whole.items()}
    first = {frozenset(c.items()): min(j for j in whole if whole[j] == c) for c in whole.values()}
    heads = [i for i in whole if norm[i] and first[frozenset(whole[i].items())] == i]
    monkeypatch.setattr(lexical, "TEXTS_PER_BLOCK", 11)
    for products, dense in ((2_000_000, 1 / 300), (37, 0.3)):
        monkeypatch.setattr(lexical, "DENSE", dense)
        monkeypatch.setattr(lexical, "PRODUCTS", products)
        for least in (0.55, 0.9):
            found = lexical.similar_texts(df, "doc_id", "text", least)
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan  # pairs were joined by their terms before
            want = {}
            for a, b in combinations(heads, 2):
                s = sum(n * whole[b][t] for t, n in whole[a].items()) / (norm[a] * norm[b])
                if round(s, 12) >= least:
                    want[a, b] = round(s, 9)
            got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in found.collect()}
            assert got == want and len(want) >= (4 if least < 0.9 else 1)


def _joins_nothing(spark, folder, name):
    import __spark_entry__ as entry

    rows = [(1, "a b c d e"), (2, "a b c x y"), (3, "a b c d x"), (4, "q r s"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = entry.queries()[name](spark, str(folder))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs were joined by their terms before
    return {(r["a"], r["b"], r["similarity"]) for r in found.collect()}


def test_audited_duplicates_join_nothing(spark, tmp_path):
    assert _joins_nothing(spark, tmp_path, "audit_duplicate_texts") == {(1, 3, 0.8), (2, 3, 0.8)}


def test_duplicates_join_nothing(spark, tmp_path):
    assert _joins_nothing(spark, tmp_path, "duplicate_texts") == {(1, 2, 0.6), (1, 3, 0.8), (2, 3, 0.8)}


def _rounded_in_tasks(spark, folder, name):
    import __spark_entry__ as entry

    # Lengths 8 and 16, sum of products 117: 117 / 128 = 0.9140625 lies halfway.
    terms = [f"t{i}" for i in range(64)]
    rows = [(1, " ".join(terms)), (2, " ".join(terms + terms[:53] + ["u"] * 5 + ["v", "w"] * 2)), (3, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = entry.queries()[name](spark, str(folder))
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()  # every pair was made a decimal before
    return {(r["a"], r["b"], r["similarity"]) for r in found.collect()}


def test_audited_duplicates_are_rounded_in_tasks(spark, tmp_path):
    assert _rounded_in_tasks(spark, tmp_path, "audit_duplicate_texts") == {(1, 2, 0.914063)}


def test_duplicates_are_rounded_in_tasks(spark, tmp_path):
    assert _rounded_in_tasks(spark, tmp_path, "duplicate_texts") == {(1, 2, 0.914063)}
