"""Ranking against a stated set of queries without a row per pair."""

import random

from mnemoframe.operators import lexical


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_search_shuffles_only_the_best(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, draw.choice(words), " ".join(draw.choices(words, k=3)), " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(300)], "doc_id long, name string, description string, body string").repartition(3)
    asked = docs.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "description AS query")
    found = lexical.tfidf_search(docs, asked, k=4)
    # Documents and queries were joined on their terms before: a row for each term of each pair.
    assert "Join" not in _plan(found)
    from math import log

    rows = [(r["doc_id"], r["name"], r["description"], f"{r['name']} {r['description']} {r['body']}".split()) for r in docs.collect()]
    df = {w: sum(w in r[3] for r in rows) for w in words}
    want = set()
    for q in asked.collect():
        scores = []
        for key, name, said, all_ in rows:
            score = sum(all_.count(t) / len(all_) * (log(301 / (df[t] + 1)) + 1) + 0.5 * (t in name) + 0.2 * (t in said) for t in q["query"].split() if t in all_)
            if score > 0:
                scores.append((-round(score, 10), key))
        want |= {(q["query_id"], key, n + 1) for n, (_, key) in enumerate(sorted(scores)[:4])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()} == want


def test_equal_documents_come_in_the_order_of_their_keys(spark):
    docs = spark.createDataFrame([(i, "same", None, "text") for i in (9, 3, 7, 1, 5)] + [(None, "same", "same", "same"), (2, None, None, None)], "doc_id long, name string, description string, body string").repartition(2)
    asked = spark.createDataFrame([(1, "same text"), (2, None), (3, "nothing")], "query_id long, query string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in lexical.tfidf_search(docs, asked, k=3).orderBy("rank").collect()] == [(1, 1, 1), (1, 3, 2), (1, 5, 3)]
    assert lexical.tfidf_search(docs, asked.limit(0)).collect() == [] and lexical.tfidf_search(docs.limit(0), asked).collect() == []


def test_phrases_are_counted_within_words_and_without_overlaps(spark):
    docs = spark.createDataFrame([(1, "banana BANANAS\nanana x"), (2, "ana\tana  ana"), (3, "b a n a"), (4, None), (5, "aaaa aaa")], "doc_id long, body string")
    asked = spark.createDataFrame([(1, "ana banana ana"), (2, "AAA no"), (3, None)], "query_id long, query string")
    found = lexical.phrase_search(docs, asked)
    assert {(r["query_id"], r["doc_id"], r["score"], r["line"], r["rank"]) for r in found.collect()} == {(1, 1, 5, "banana BANANAS", 1), (1, 2, 3, "ana\tana  ana", 2), (2, 5, 2, "aaaa aaa", 1)}
    # Each text was held against each query's words before, a row for each hit.
    assert "Generate" not in _plan(lexical.phrase_search(docs, asked, lines=False))


def test_drafts_and_files_meet_without_a_row_per_pair(spark):
    from mnemoframe.operators import upkeep

    text = " ".join(f"w{i}" for i in range(25))
    files = spark.createDataFrame([(i, "note", "", f"{text} x{i % 3}", "") for i in range(12)], "file long, name string, description string, body string, type string")
    drafts = spark.createDataFrame([(1, 0, "note", f"{text} x0"), (2, None, "note", f"{text} x1 x1"), (3, None, "note", "too short")], "id long, file long, name string, content string")
    found = upkeep.write_conflicts(drafts, files)
    assert {(r["id"], r["file"], r["rank"]) for r in found.where("kind = 'similar'").collect()} == {(2, 1, 1), (2, 4, 2), (2, 7, 3)}
    assert [(r["id"], r["file"]) for r in found.where("kind = 'exact'").collect()] == [(1, 0)]
    joins = _plan(found.where("kind = 'similar'")).count("Join")
    assert joins == 0


def test_recent_matches_join_no_rows_by_their_terms(spark):
    draw = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=5)) if i % 17 else None, draw.choice([None, *range(20)])) for i in range(200)], "doc_id long, text string, at long").repartition(3)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["word1 word2", "word3-word4 word5_word6", "word7 word7", "absent", None, "word8-word9-word10"])], "query_id long, query string")
    found = lexical.recent_matches(docs, asked, "doc_id", "text", "at")
    assert "word" not in _plan(found) and "Generate" not in _plan(found)  # there was a row for each term of each document
    rows, want = docs.collect(), set()
    for q in asked.collect():
        terms = [set(t.replace("_", "-").split("-")) for t in (q["query"] or "").split()]
        hits = [r for r in rows if any(t <= set((r["text"] or "").split()) for t in terms)]
        hits.sort(key=lambda r: (r["at"] is None, -(r["at"] or 0), r["doc_id"]))
        want |= {(q["query_id"], r["doc_id"], n + 1) for n, r in enumerate(hits[:3])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()} == want and len(want) > 8
    assert lexical.recent_matches(docs, asked.limit(0), "doc_id", "text", "at").collect() == []


def test_merged_matches_join_no_rows_by_their_terms(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(50 * i, f"alpha beta row{i}", " Session_Epilogue " if i % 2 else "note", None) for i in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, written_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["merged_matches"](spark, str(tmp_path))
    assert "Generate" not in _plan(found)  # there was a row for each term of each document
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect()} == {(q * 50, k, s, n) for q in range(1, 6) for k, s, n in ((50, 0.55, 1), (150, 0.55, 2), (250, 0.55, 3))}


def _ranked_in_tasks(spark, folder, name):
    """The query's rows; they equal its SQL's, and no text is taken apart into rows of terms, as all were before."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(i, f"alpha beta w{i % 4} row{i}" if i != 100 else "of no row", "note") for i in range(10, 301, 10)] + [(350, None, "note")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 7), float(i % 11)], i % 3) for i in range(1, 121)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    found = entry.queries()[name](spark, str(folder))
    assert "regexp_extract_all" not in _plan(found)
    with duckdb.connect() as db:
        for table in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
        want = db.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_floor_suite_ranks_in_tasks(spark, tmp_path):
    assert {r[:2] for r in _ranked_in_tasks(spark, tmp_path, "floor_suite")} == {(i, i < 350) for i in range(50, 351, 50)}


def test_run_summary_ranks_in_tasks(spark, tmp_path):
    assert [r[:3] for r in _ranked_in_tasks(spark, tmp_path, "run_summary")] == [(7, 6, 1)]


def test_run_difference_ranks_in_tasks(spark, tmp_path, monkeypatch):
    from mnemoframe.plans import quality_queries

    monkeypatch.setattr(quality_queries, "as_table", lambda df, *_: df, raising=False)  # its plan is that of the ranking then
    assert {r[1] for r in _ranked_in_tasks(spark, tmp_path, "run_difference")} >= {"regression", "new pass"}


def test_unified_recall_ranks_in_tasks(spark, tmp_path):
    assert {r[1] for r in _ranked_in_tasks(spark, tmp_path, "unified_recall")} == {"notes", "vectors"}
