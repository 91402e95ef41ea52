"""Queries of readers and text edits: each document's number and place are written into a text, which is then read or edited.

The SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.operators import state
from mnemoframe.plans.tables import table
from mnemoframe.sources import readers, writers

CATALOG = Catalog()


def _texts(spark, d, text: str):
    """``doc_id, filename, content``: the SQL expression ``text`` over documents."""
    return table(spark, d, "documents").select("doc_id", F.expr("concat('n', doc_id, '.md')").alias("filename"), F.expr(text).alias("content"))


@CATALOG.query("strict_headers", "SELECT doc_id, 'Q ' || doc_id AS name, 'y' AS ok_2, 2 AS fields FROM documents")
def strict_headers(spark, d):
    rows = _texts(spark, d, r"""concat('---\nname: "Q ', doc_id, '"\n1bad: x\nnot-one: y\nok_2 : \'y\'\nname: "Q ', doc_id, '"\n---\nbody')""")
    fields = readers.front_matter("content", True)
    return rows.select("doc_id", fields["name"].alias("name"), fields["ok_2"].alias("ok_2"), F.size(fields).alias("fields"))


@CATALOG.query("header_bodies", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Body ' || doc_id || chr(10) || '---' || chr(10) ELSE '--' || chr(10) || doc_id END AS body FROM documents")
def header_bodies(spark, d):
    rows = _texts(spark, d, r"if(doc_id % 2 = 0, concat('---\na: b\n---\n\nBody ', doc_id, '\n---\n'), concat('--\n', doc_id))")
    return rows.select("doc_id", readers.body_of("content").alias("body"))


@CATALOG.query("thread_list", "SELECT doc_id AS key, 't' || doc_id AS id, doc_id % 3 = 0 AS done, 'fix — ' || coalesce(lang, '-') AS body, CASE WHEN doc_id % 2 = 0 THEN '2026-01-02' END AS opened FROM documents")
def thread_list(spark, d):
    rows = _texts(spark, d, r"concat('# Open\n- [', if(doc_id % 3 = 0, 'x', ' '), '] t', doc_id, ' — fix — ', coalesce(lang, '-'), if(doc_id % 2 = 0, ' _(opened 2026-01-02)_', ''), '\n- [ ] bad — no\n')")
    return readers.threads(rows, "doc_id")


@CATALOG.query("probe_texts", "SELECT 'n' || doc_id AS slug, '2026-02-03' AS date, 'daily' AS probe_type, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE '' END AS result, 'I am' || chr(10) || doc_id AS response FROM documents")
def probe_texts(spark, d):
    return readers.probes(_texts(spark, d, r"concat('---\ndate: 2026-02-03\nprobe_type: daily\n', if(doc_id % 2 = 0, 'result: ok\n', ''), '---\n## Response here\n\n```text\nI am\n', doc_id, '\n```\n')"))


@CATALOG.query("candidate_texts", "SELECT 'c/' || doc_id || '.md' AS path, doc_id AS first_id, 'l' || doc_id || '.md' AS recommended, (doc_id % 100) / 100.0::DOUBLE AS cluster_score, doc_id AS generated_at, 's' || doc_id AS source_session, CASE WHEN doc_id % 5 = 0 THEN '(no clear topic)' ELSE 'ledger ' || doc_id END AS topic, 'a.py' AS top_file FROM documents WHERE doc_id % 3 <> 0")
def candidate_texts(spark, d):
    ids = "if(doc_id % 3 = 0, '[1, x]', concat('[', doc_id, ', 2]'))"
    topic = r"if(doc_id % 5 = 0, '', concat('## Topic\nledger ', doc_id, '\n'))"
    rows = _texts(spark, d, rf"concat('source_obs_ids: ', {ids}, '\ncluster_score: ', round(doc_id % 100 / 100, 2), '\ngenerated_at: ', doc_id, '\nsource_session: s', doc_id, '\n', {topic}, '## Recommended memory file\n`l', doc_id, '.md`\n## Files involved\n- `a.py`\n')")
    found = readers.candidates(rows.withColumn("path", F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit(".md"))))
    return found.select("path", F.col("obs_ids")[0].alias("first_id"), "recommended", "cluster_score", "generated_at", "source_session", "topic", "top_file")


@CATALOG.query("pending_paths", "SELECT DISTINCT CASE doc_id % 4 WHEN 1 THEN 'a/archived.md' ELSE 'a/b/' || doc_id END AS path FROM documents WHERE doc_id % 4 < 2")
def pending_paths(spark, d):
    rows = table(spark, d, "documents").select(F.expr("CASE doc_id % 4 WHEN 0 THEN concat('a/b/', doc_id) WHEN 1 THEN 'a/archived.md' WHEN 2 THEN concat('a/archived/', doc_id) ELSE concat('promoted/x/', doc_id) END").alias("path"))
    return readers.pending(rows).distinct()


@CATALOG.query("hook_payloads", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 's' || doc_id END AS session, CASE WHEN doc_id % 5 <> 0 THEN 'Read' END AS tool FROM documents")
def hook_payloads(spark, d):
    rows = _texts(spark, d, """if(doc_id % 5 = 0, '{torn', concat('{"session_id": "', if(doc_id % 2 = 0, concat('s', doc_id), ''), '", "sessionId": "s', doc_id, '", "toolName": "Read"}'))""")
    payload = readers.hook_payload("content", {"session": ("session_id", "sessionId"), "tool": ("tool_name", "toolName")})
    return rows.select("doc_id", payload.alias("p")).select("doc_id", "p.session", "p.tool")


@CATALOG.query("tool_paths", "SELECT doc_id, 'f' || doc_id || ',g,' || 'h' || doc_id AS paths FROM documents")
def tool_paths(spark, d):
    rows = _texts(spark, d, """concat('{"file_path": "f', doc_id, '", "files": ["g", "f', doc_id, '", ""], "edits": [{"file_path": "h', doc_id, '"}]}')""")
    return rows.select("doc_id", F.array_join(readers.tool_paths("content"), ",").alias("paths"))


@CATALOG.query("json_lines", "SELECT doc_id AS id, 'x' AS kind, 0 AS torn FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT NULL, NULL, count(*) FROM documents WHERE doc_id % 4 = 0")
def json_lines(spark, d):
    rows = _texts(spark, d, """CASE doc_id % 8 WHEN 0 THEN '{"id": 1' WHEN 4 THEN '[1]' ELSE concat('{"id": ', doc_id, ', "kind": "x", "more": 1}') END""").select(F.col("content").alias("value"))
    good, torn = readers.parsed_json_lines(rows, "id bigint, kind string")
    return good.withColumn("torn", F.lit(0).cast("long")).unionByName(torn.agg(F.count("*").alias("torn")).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("kind"), "torn"))


@CATALOG.query("edited_headers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'name: x' || chr(10) || 'related: a.md, b' || doc_id || '.md' || chr(10) || '---' || chr(10) || 'body' WHEN 1 THEN '---' || chr(10) || 'name: x' || chr(10) || 'related: b' || doc_id || '.md' || chr(10) || '---' || chr(10) || 'body' ELSE 'plain' END AS linked,
CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'name: x' || chr(10) || 'related: a.md' || chr(10) || 'corroborations: 1' || chr(10) || 'last_corroborated: 2026-02-02' || chr(10) || '---' || chr(10) || 'body' WHEN 1 THEN '---' || chr(10) || 'name: x' || chr(10) || 'corroborations: ' || (doc_id + 1) || chr(10) || 'last_corroborated: 2026-02-02' || chr(10) || '---' || chr(10) || 'body' ELSE 'plain' END AS bumped FROM documents""")
def edited_headers(spark, d):
    rows = _texts(spark, d, r"CASE doc_id % 3 WHEN 0 THEN '---\nname: x\nrelated: a.md\n---\nbody' WHEN 1 THEN '---\nname: x\n---\nbody' ELSE 'plain' END")
    counted = F.when(F.col("doc_id") % 3 == 1, F.expr(r"concat('---\nname: x\ncorroborations: ', doc_id, '\n---\nbody')")).otherwise(F.col("content"))
    link = F.array(F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit(".md")))
    return rows.select("doc_id", writers.with_related("content", link).alias("linked"), writers.bumped(counted, "2026-02-02").alias("bumped"))


@CATALOG.query("spliced_indexes", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'head' || chr(10) || '{writers.MARK_START}' || chr(10) || 'new ' || doc_id || chr(10) || '{writers.MARK_END}' || chr(10) || 'tail'
ELSE 'head' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '{writers.MARK_START}' || chr(10) || 'new ' || doc_id || chr(10) || '{writers.MARK_END}' || chr(10) END AS text FROM documents""")
def spliced_indexes(spark, d):
    rows = _texts(spark, d, rf"if(doc_id % 2 = 0, 'head\n{writers.MARK_START}\nold\nlines\n{writers.MARK_END}\ntail', 'head')")
    return rows.select("doc_id", writers.spliced("content", F.concat(F.lit("new "), F.col("doc_id").cast("string"))).alias("text"))


@CATALOG.query("graduated_candidates", """WITH c AS (SELECT doc_id, 'p' || doc_id AS path, doc_id % 10 AS topic, doc_id % 4 <> 0 AND doc_id % 10 <> 7 AS graduates FROM documents),
n AS (SELECT path, graduates, topic, row_number() OVER (PARTITION BY topic, graduates ORDER BY doc_id) + CASE WHEN topic = 3 THEN 1 ELSE 0 END AS n FROM c)
SELECT path, graduates, CASE WHEN graduates THEN 'session_ledger-' || topic || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.md' END AS filename FROM n""")
def graduated_candidates(spark, d):
    rows = table(spark, d, "documents").select(
        F.expr("concat('p', doc_id)").alias("path"), F.array("doc_id").alias("obs_ids"), F.col("doc_id").alias("generated_at"), F.expr("if(doc_id % 10 = 7, '(no clear topic)', concat('Ledger-', doc_id % 10))").alias("topic"),
        F.expr("if(doc_id % 4 = 0, 0.1D, 0.9D)").alias("cluster_score"),
    )
    taken = spark.createDataFrame([("session_ledger-3.md",)], "filename string")
    return writers.graduations(rows, taken, 0.5).select("path", "graduates", "filename")


@CATALOG.query("debounced_events", """WITH RECURSIVE e AS (SELECT user_id || '|' || event_type AS content, CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events WHERE strlen(props) <= 4096),
f AS (SELECT content, tm, id, n, tm AS last, true AS keep FROM e WHERE n = 1 UNION ALL SELECT e.content, e.tm, e.id, e.n, CASE WHEN e.tm - f.last >= 21600 THEN e.tm ELSE f.last END, e.tm - f.last >= 21600 FROM f JOIN e ON e.content = f.content AND e.n = f.n + 1)
SELECT content, tm::DOUBLE AS "at", id FROM f WHERE keep""")
def debounced_events(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat("user_id", F.lit("|"), "event_type").alias("content"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "props")
    return state.debounced(rows, F.col("content"), "at", "event_id", F.col("props"), seconds=6 * 3600)
