import random

import __spark_entry__ as entry


def test_stretches_come_out_for_every_document(spark, tmp_path):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    common, copy = text(300), text(260)
    rows = [(1, "1" * 10 + common + "1" * 50), (2, "2" * 70 + common + "2"), (3, copy), (4, copy), (5, text(400)), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["p9_spans"](spark, str(tmp_path)).select("doc_id", "begin", "end").collect()}
    assert got == {(1, 10, 310), (2, 70, 370), (3, 0, 260), (4, 0, 260)}
