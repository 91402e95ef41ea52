"""Results that earlier versions cut short."""

import pytest

import __spark_entry__ as entry
from mnemoframe import durable
from mnemoframe.operators import fusion, graph, lexical, state, vectors


def test_duplicates_from_the_references_limit_on(spark, tmp_path):
    # Cosines with document 1: 0.6 and 0.8; documents 2 and 3 have 0.8.
    rows = [(1, "a b c d e"), (2, "a b c x y"), (3, "a b c d x"), (4, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in lexical.similar_texts(df, "doc_id", "text").collect()} == {(1, 2), (1, 3), (2, 3)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda name: {(r["a"], r["b"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert pairs("duplicate_texts") == {(1, 2), (1, 3), (2, 3)}
    assert pairs("audit_duplicate_texts") == {(1, 3), (2, 3)}


def test_stems_vote_wherever_they_stand(spark):
    names = ["observer_counter.md", "plan_v2.md", "a_b_c_d_e_f_g_h_i_j.md", "c++.notes.md", "größe_x.md", "two__bars.md", "short.md", "absent_one.md"]
    files = spark.createDataFrame(list(enumerate(names)), "key long, filename string")
    said = [(1, "see observer_counters"), (2, "plan_v2-old"), (3, "A b c d e f g h i j"), (4, "the c++.notes, größe x and two__bars; short"), (5, None)]
    got = {(r["query_id"], r["key"]) for r in fusion.filename_votes(spark.createDataFrame(said, "query_id long, query string"), files).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (4, 4), (4, 5)}


def test_files_are_linked_by_names_anywhere_and_stems_at_boundaries(spark):
    bodies = {
        "a.md": "project_alpha-related", "b.md": "project_alpha.txt", "c.md": "x-project_alpha or x.project_alpha", "d.md": "xproject_alpha.mdx", "e.md": "xproject_alpha, project_alphas",
        "f.md": "my plan (v2) and c++ größe", "project_alpha.md": "project_alpha", "my plan.md": None, "größe.md": "",
    }
    df = spark.createDataFrame([(f, None, b) for f, b in bodies.items()], "filename string, related array<string>, body string")
    got = {(r["from_file"], r["to_file"]) for r in graph.linked_files(df).collect()}
    # The stem "c" stands between boundaries in "c++", the name "a.md" within "xproject_alpha.mdx".
    assert got == {(f, "project_alpha.md") for f in ("a.md", "b.md", "c.md", "d.md")} | {("f.md", "my plan.md"), ("f.md", "größe.md"), ("f.md", "c.md"), ("d.md", "a.md")}


def test_entities_of_many_words_and_other_letters(spark):
    names = ["one two three four five six seven eight", "猫の手帳", "Größe neun", "+++", "plain"]
    docs = spark.createDataFrame([(1, "x: One two three four five six seven eight."), (2, "das 猫の手帳 und größe neun"), (3, "a+++b"), (4, "explain gr neun")], "doc_id long, body string")
    keys = spark.createDataFrame([(n, n) for n in names], "key_text string, canonical string")
    want = {(1, names[0]), (2, names[1]), (2, names[2]), (3, names[3])}
    assert {(r["doc_id"], r["canonical"]) for r in graph.mentions_of(docs, keys).collect()} == want
    entities = spark.createDataFrame([(n, n, None) for n in names], "id string, name string, aliases array<string>")
    asked = docs.selectExpr("doc_id AS query_id", "body AS query")
    assert {(r["query_id"], r["id"]) for r in graph.query_entities(asked, entities).collect()} == want


def test_vectors_are_held_against_those_of_their_length(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, []), (6, None)], "key long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.1, 0.0]), (4, None)], "query_id long, vector array<double>")
    got = {(r["query_id"], r["key"]) for r in vectors.vector_topk(rows, asked, 1).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}
    assert {(r["a"], r["b"]) for r in vectors.close_pairs(rows, 0.7).collect()} == {(3, 4)}
    assert vectors.vector_topk(rows, asked.limit(0), 1).collect() == [] and vectors.vector_topk(rows.limit(0), asked, 1).collect() == []


def test_insert_or_ignore_takes_the_first_by_all_columns(spark):
    table = spark.createDataFrame([("a", 9, "old")], "k string, n int, t string")
    rows = spark.createDataFrame([("b", 2, "x"), ("b", 1, "z"), ("b", 1, "y"), ("a", 1, "new"), ("c", None, None), ("c", 1, "w")], "k string, n int, t string")
    assert {tuple(r) for r in state.inserted(table, rows, ["k"]).collect()} == {("a", 9, "old"), ("b", 1, "y"), ("c", None, None)}


def test_a_cluster_has_to_name_the_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError):
        durable.shared_folder(Session())
