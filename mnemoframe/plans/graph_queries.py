"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions.names import common_file_name
from mnemoframe.functions.text import user_verb_patterns
from mnemoframe.operators import graph as G
from mnemoframe.plans import views as V
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

CATALOG = Catalog()
_MENTIONS = f"mm AS (SELECT entity_id, {name_sql('memory_filename')} AS file, ts FROM entity_mentions)"


@CATALOG.query("entity_upsert", "SELECT c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS type, min(c_custkey) AS first_seen, max(c_custkey) AS last_seen, max(c_acctbal) AS confidence FROM customer GROUP BY ALL")
def entity_upsert(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("type"), F.lit(None).cast("array<string>").alias("aliases"), F.col("c_custkey").alias("ts"), F.col("c_acctbal").alias("confidence"))
    return G.upserted_entities(rows).drop("aliases")


@CATALOG.query("entity_lookup", f"WITH {V.NODES_SQL} SELECT lower(n_name) AS name, min(id) AS id FROM nation JOIN nodes ON lower(name) = lower(n_name) GROUP BY 1")
def entity_lookup(spark, d):
    return G.entities_named(V.nodes(spark, d), table(spark, d, "nation").select(F.lower("n_name").alias("name")))


@CATALOG.query("entity_list", f"WITH {V.NODES_SQL} SELECT id, name FROM nodes WHERE type = 'supplier' ORDER BY id % 7 DESC, id LIMIT 100")
def entity_list(spark, d):
    return G.listed_entities(V.nodes(spark, d).withColumn("confidence", F.col("id") % 7), "supplier").select("id", "name")


_RUNS = f"""{V.FACTS_SQL}, l AS (SELECT *, CASE WHEN lag(object) OVER (PARTITION BY subject, type ORDER BY ts, seq) IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh FROM facts),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, type ORDER BY ts, seq) AS run FROM l),
g AS (SELECT subject, type, run, any_value(object) AS object, min(ts) AS valid_from, min(ts * 1000000000 + seq) AS first, count(*) AS asserted FROM r GROUP BY ALL),
iv AS (SELECT subject, type, object, valid_from, lead(valid_from) OVER w AS valid_to, lead(object) OVER w AS superseded_by, asserted FROM g WINDOW w AS (PARTITION BY subject, type ORDER BY first))"""


@CATALOG.query("fact_intervals", f"WITH {_RUNS} SELECT * FROM iv")
def fact_intervals(spark, d):
    return G.fact_intervals(V.facts(spark, d))


@CATALOG.query("fact_intervals_strict", f"""WITH {V.FACTS_SQL}, g AS (SELECT subject, type, object, min(ts * 1000000000 + seq) AS first, arg_min(ts, ts * 1000000000 + seq) AS valid_from, count(*) AS asserted FROM facts GROUP BY ALL)
SELECT subject, type, object, valid_from, lead(valid_from) OVER w AS valid_to, lead(object) OVER w AS superseded_by, asserted FROM g WINDOW w AS (PARTITION BY subject, type ORDER BY first)""")
def fact_intervals_strict(spark, d):
    return G.strict_fact_intervals(V.facts(spark, d))


@CATALOG.query("facts_as_of", f"WITH {_RUNS} SELECT subject, object, valid_from FROM iv WHERE valid_from <= 852076800 AND (valid_to IS NULL OR valid_to > 852076800)")
def facts_as_of(spark, d):
    return G.active_at(G.fact_intervals(V.facts(spark, d)), F.lit(852076800)).select("subject", "object", "valid_from")


@CATALOG.query("fact_chain", f"WITH {V.FACTS_SQL} SELECT seq AS id, last_value(seq) OVER (PARTITION BY subject ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current, count(*) OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS steps FROM facts")
def fact_chain(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("seq").over(Window.partitionBy("subject").orderBy("ts", "seq"))
    return G.current_rows(V.facts(spark, d).select(F.col("seq").alias("id"), nxt.alias("superseded_by")))


_STEPS = f"{V.EDGES_SQL}, st AS (SELECT from_id AS node, to_id AS nxt FROM edges UNION SELECT to_id, from_id FROM edges)"


@CATALOG.query("neighbours", f"""WITH {_STEPS}, s AS (SELECT r_regionkey + 1 AS start FROM region), h1 AS (SELECT start, nxt AS node FROM s JOIN st ON start = node), h2 AS (SELECT h1.start, st.nxt AS node FROM h1 JOIN st USING (node)),
al AS (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2) SELECT start, node, min(depth) AS depth FROM al GROUP BY ALL""")
def neighbours(spark, d):
    starts = table(spark, d, "region").select((F.col("r_regionkey").cast("long") + 1).alias("start"))
    return G.reachable(V.edges(spark, d), starts, 2)


@CATALOG.query("reachable_out", f"""WITH RECURSIVE {V.EDGES_SQL}, w AS (SELECT s_suppkey + 1001 AS start, s_suppkey + 1001 AS node, 0 AS depth FROM supplier UNION SELECT start, to_id, depth + 1 FROM w JOIN edges ON node = from_id WHERE depth < 5)
SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL""")
def reachable_out(spark, d):
    starts = table(spark, d, "supplier").select((F.col("s_suppkey") + 1001).alias("start"))
    return G.reachable(V.edges(spark, d), starts, 5, "out")


@CATALOG.query("degree_hubs", f"WITH {V.EDGES_SQL}, e AS (SELECT from_id AS node FROM edges UNION ALL SELECT to_id FROM edges WHERE to_id <> from_id) SELECT node, count(*) AS degree FROM e GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def degree_hubs(spark, d):
    return G.hubs(V.edges(spark, d))


@CATALOG.query("graph_stats", f"WITH {V.NODES_SQL}, {V.EDGES_SQL}, b AS (SELECT 'entity' AS kind, type FROM nodes UNION ALL SELECT 'edge', type FROM edges) SELECT kind, type, count(*) AS n FROM b GROUP BY ROLLUP (kind, type) HAVING kind IS NOT NULL")
def graph_stats(spark, d):
    return G.graph_stats(V.nodes(spark, d), V.edges(spark, d))


#: Edges between files that refer to each other, and files as seeds.
_REFS = f"""rf AS (SELECT DISTINCT {name_sql("from_file")} AS f, {name_sql("to_file")} AS t FROM refs), nm AS (SELECT f AS name FROM rf WHERE f IS NOT NULL UNION SELECT t FROM rf WHERE t IS NOT NULL),
rn AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM nm), re AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, count(*) * 1.0::DOUBLE AS w FROM rf JOIN rn a ON f = a.name JOIN rn b ON t = b.name WHERE a.id <> b.id GROUP BY ALL)"""


#: Seeds: each nation asks from its own node.
_NATION_SEEDS = "SELECT n_nationkey AS query_id, n_nationkey + 101 AS node, 1.0::DOUBLE AS rank FROM nation"


def ppr_ctes(seeds: str = _NATION_SEEDS, steps: int = G.ITERATIONS) -> str:
    """Tables up to ``ppr`` (query_id, node, rank) in SQL; ``edges`` is among them."""
    edges = f"{V.EDGES_SQL}, uw AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, sum(greatest(0.05, confidence)) AS w FROM edges WHERE from_id <> to_id GROUP BY ALL), di AS (SELECT a AS src, b AS dst, w FROM uw UNION ALL SELECT b, a, w FROM uw), mv AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM di)"
    parts = [edges, f"ps AS ({seeds})", "r0 AS MATERIALIZED (SELECT * FROM ps)"]
    for i in range(1, steps + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT query_id, node, sum(rank) AS rank FROM (SELECT query_id, dst AS node, 0.85 * rank * p AS rank FROM r{i - 1} JOIN mv ON node = src UNION ALL SELECT query_id, node, 0.15 * rank FROM ps) GROUP BY ALL)")
    return ", ".join([*parts, f"ppr AS (SELECT * FROM r{steps})"])


def _ppr_sql(steps: int) -> str:
    return f"WITH {ppr_ctes(steps=steps)} SELECT query_id, node, round(rank, 8) AS rank FROM ppr WHERE rank > 1e-6"


def _ranks(spark, d, small):
    weights = G.edge_weights(V.edges(spark, d), V.NOW)
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), (F.col("n_nationkey").cast("long") + 101).alias("node"))
    return G.personalised_rank(weights, seeds, small=small)


@CATALOG.query("ppr_nodes", _ppr_sql(G.ITERATIONS))
def ppr_nodes(spark, d):
    return _ranks(spark, d, G.SMALL_GRAPH).where("rank > 1e-6").withColumn("rank", F.round("rank", 8))


@CATALOG.query("ppr_nodes_by_joins", _ppr_sql(G.ITERATIONS))
def ppr_nodes_by_joins(spark, d):
    return _ranks(spark, d, 0).where("rank > 1e-6").withColumn("rank", F.round("rank", 8))


#: Documents mention a nation and, if there is one of their number, a supplier.
_SAID_BY = "sb AS (SELECT doc_id AS key, 101 + doc_id % 25 AS node FROM documents UNION SELECT doc_id, s_suppkey + 1001 FROM documents JOIN supplier ON s_suppkey = doc_id)"
RANKED_FILES_SQL = f"""{_SAID_BY}, pb AS (SELECT query_id, node, rank FROM ppr WHERE rank > 1e-4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 12) DESC, node) <= 50),
pf AS (SELECT query_id, key, sum(rank) AS score FROM pb JOIN sb USING (node) GROUP BY ALL), gra AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) AS rank FROM pf)"""


def mentions(spark, d):
    """``entity_id, filename``: which document mentions which node of the graph."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("filename"))
    nations = docs.select((101 + F.col("filename") % 25).cast("long").alias("entity_id"), "filename")
    suppliers = docs.join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("filename")), "filename").select((F.col("filename") + 1001).alias("entity_id"), "filename")
    return nations.unionByName(suppliers)


@CATALOG.query("ppr_files", f"WITH {ppr_ctes()}, {RANKED_FILES_SQL} SELECT query_id, key, round(score, 6) AS score, rank FROM gra WHERE rank <= 8")
def ppr_files(spark, d):
    return G.ranked_files(_ranks(spark, d, G.SMALL_GRAPH), mentions(spark, d), 8).withColumn("score", F.round("score", 6))


_SEEDS = "seeds AS (SELECT unnest(['ledger', 'open question', 'next step', 'timeouterror']) AS key_low, unnest(['Ledger', 'Question', 'Step', 'TimeoutError']) AS canonical UNION ALL SELECT 'permissiondenied', 'TimeoutError')"


@CATALOG.query("mention_extract", f"""WITH {_SEEDS}, w AS (SELECT doc_id, text, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents),
h AS (SELECT doc_id, canonical, arg_max(key_low, length(key_low)) AS k, any_value(text) AS text FROM w JOIN seeds ON contains(t, ' ' || key_low || ' ') GROUP BY ALL)
SELECT doc_id, canonical, substr(trim(coalesce(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: contains(lower(x), k))[1], '')), 1, 200) AS excerpt FROM h""")
def mention_extract(spark, d):
    keys = spark.createDataFrame([("ledger", "Ledger"), ("open question", "Question"), ("next step", "Step"), ("timeouterror", "TimeoutError"), ("permissiondenied", "TimeoutError")], "key_text string, canonical string")
    return G.mentions_of(V.docs(spark, d), keys)


@CATALOG.query("query_entities", f"WITH {V.NODES_SQL} SELECT DISTINCT doc_id AS query_id, id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(name || ' from nation_3 and Region_1'), '[a-z0-9]+'), ' ') || ' ' AS t FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 40) AS name FROM documents WHERE doc_id % 50 = 0)) q JOIN nodes ON contains(t, ' ' || array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') || ' ') WHERE type <> 'region'")
def query_entities(spark, d):
    asked = V.docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.coalesce("name", F.lit("")), F.lit(" from nation_3 and Region_1")).alias("query"))
    entities = V.nodes(spark, d).where("type <> 'region'").withColumn("aliases", F.lit(None).cast("array<string>"))
    return G.query_entities(asked, entities)


@CATALOG.query("linked_files", f"""WITH {V.FILES_SQL}, {V.RELATED_SQL}, k AS (SELECT DISTINCT file AS to_file, file AS tok FROM files UNION SELECT file, regexp_replace(file, '\\.md$', '') FROM files),
w AS (SELECT file AS from_file, unnest(list_distinct(regexp_extract_all(coalesce(description, ''), '[A-Za-z0-9_][A-Za-z0-9_.-]*'))) AS tok FROM files)
SELECT DISTINCT file AS from_file, other AS to_file FROM rel WHERE file IS NOT NULL AND other IN (SELECT file FROM files) AND other <> file
UNION SELECT DISTINCT from_file, to_file FROM w JOIN k ON regexp_replace(w.tok, '[.-]+$', '') = k.tok OR w.tok = k.tok WHERE from_file <> to_file""")
def linked_files(spark, d):
    links = V.related(spark, d).where("file IS NOT NULL").groupBy("file").agg(F.collect_set("other").alias("related"))
    rows = V.files(spark, d).join(links, "file", "left").select(F.col("file").alias("filename"), "related", F.col("description").alias("body"))
    return G.linked_files(rows)


_SAID = "coalesce(text, '') || ' Ada relies on Tool_' || doc_id || '; Ada uses X. Ada manages Team ' || doc_id || ', Crew and more. Plan-' || doc_id || ' written by Ada'"


@CATALOG.query("verb_edges", rf"""WITH d AS (SELECT doc_id, {_SAID} AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '\bAda\s+(?:uses|runs|relies\s+on|loves)\s+([A-Z][\w/_.-]+)', 1)) AS object, 'uses' AS type FROM d
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '\bAda\s+manages\s+([A-Z][\w\s,.-]+?)(?:\.|,| and|;|$)', 1)), 'manages' FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '\b([A-Z][\w_-]+)\s+(?:built\s+by|written\s+by|by)\s+Ada', 1)), 'built_by' FROM d)
SELECT DISTINCT 'Ada' AS subject, type, trim(object) AS object, 0.6::DOUBLE AS confidence, doc_id AS source FROM m WHERE length(trim(object)) BETWEEN 3 AND 50""")
def verb_edges(spark, d):
    said = V.docs(spark, d).withColumn("body", F.expr(_SAID.replace("text", "body")))
    return G.verb_edges(said, user_verb_patterns("Ada"), "Ada")


@CATALOG.query("related_edges", f"WITH {V.FILES_SQL}, {V.RELATED_SQL} SELECT DISTINCT a.name AS from_name, b.name AS to_name, 'related_to' AS type, rel.file AS source FROM rel JOIN files a ON rel.file = a.file JOIN files b ON rel.other = b.file")
def related_edges(spark, d):
    links = V.related(spark, d).where("file IS NOT NULL AND other IS NOT NULL").groupBy("file").agg(F.collect_set("other").alias("related"))
    return G.related_edges(V.files(spark, d).join(links, "file", "left").select(F.col("file").alias("filename"), "name", "related"))


@CATALOG.query("graph_projection", f"WITH {V.EDGES_SQL}, e AS (SELECT from_id AS node FROM edges UNION ALL SELECT to_id FROM edges WHERE to_id <> from_id), g AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT node, degree, 6 + least(20, degree) + CASE WHEN node BETWEEN 101 AND 103 THEN 6 ELSE 0 END AS size, node BETWEEN 101 AND 103 AS in_focus FROM g")
def graph_projection(spark, d):
    focus = V.nodes(spark, d).where("id BETWEEN 101 AND 103").select(F.col("id").alias("node"))
    return G.projected_nodes(V.edges(spark, d), focus)


@CATALOG.query("lineage_edges", f"""WITH {_MENTIONS}, {V.RELATED_SQL} SELECT DISTINCT 'mentions' AS type, CAST(entity_id AS VARCHAR) AS src, file AS dst FROM mm WHERE file IS NOT NULL
UNION SELECT 'refers', {name_sql("from_file")}, {name_sql("to_file")} FROM refs WHERE {name_sql("from_file")} IS NOT NULL AND {name_sql("to_file")} IS NOT NULL
UNION SELECT 'related', file, other FROM rel WHERE file IS NOT NULL AND other IS NOT NULL
UNION SELECT 'written_in', CAST(doc_id AS VARCHAR), session_id FROM documents WHERE session_id IS NOT NULL""")
def lineage_edges(spark, d):
    return G.typed_edges({
        "mentions": table(spark, d, "entity_mentions").select(F.col("entity_id").alias("src"), common_file_name("memory_filename").alias("dst")),
        "refers": table(spark, d, "refs").select(common_file_name("from_file").alias("src"), common_file_name("to_file").alias("dst")),
        "related": V.related(spark, d).select(F.col("file").alias("src"), F.col("other").alias("dst")),
        "written_in": table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.col("session_id").alias("dst")),
    })


@CATALOG.query("week_chain", "WITH w AS (SELECT DISTINCT isoyear(written_at) || '-W' || lpad(CAST(weekofyear(written_at) AS VARCHAR), 2, '0') AS week FROM documents WHERE written_at IS NOT NULL) SELECT week, lead(week) OVER (ORDER BY week) AS next_week FROM w")
def week_chain(spark, d):
    from pyspark.sql import Window

    from mnemoframe.functions.text import iso_week

    weeks = table(spark, d, "documents").where("written_at IS NOT NULL").select(iso_week(F.col("written_at").cast("date")).alias("week")).distinct()
    return weeks.withColumn("next_week", F.lead("week").over(Window.orderBy("week")))


@CATALOG.query("parallel_facts", "SELECT o_custkey AS from_id, lower(o_orderpriority) AS type, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND epoch(o_orderdate) < 852076800 GROUP BY ALL HAVING count(*) > 1")
def parallel_facts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("from_id"), F.lower("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("valid_to"), F.lit(None).cast("long").alias("superseded_by"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"))
    return G.parallel_facts(rows, ("1-urgent", "2-high"), 852076800)


@CATALOG.query("edge_weights", f"WITH {_REFS} SELECT a, b, round(w, 6) AS w FROM re")
def edge_weights(spark, d):
    from pyspark.sql import Window

    refs = table(spark, d, "refs").select(common_file_name("from_file").alias("f"), common_file_name("to_file").alias("t")).distinct()
    names = refs.select(F.explode(F.array("f", "t")).alias("name")).where("name IS NOT NULL").distinct()
    ids = names.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    edges = refs.join(ids.select(F.col("name").alias("f"), F.col("id").alias("from_id")), "f").join(ids.select(F.col("name").alias("t"), F.col("id").alias("to_id")), "t")
    full = edges.select("from_id", "to_id", F.lit(1.0).alias("confidence"), *[F.lit(None).cast("long").alias(c) for c in ("created", "valid_to", "superseded_by")])
    return G.edge_weights(full, V.NOW).withColumn("w", F.round("w", 6))
