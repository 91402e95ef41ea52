"""Queries of the training-data operators over the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions.names import common_file_name, epoch_second, trimmed
from mnemoframe.llm.groups import connected_groups
from mnemoframe.llm.history import near_duplicates_of_history, repeated_records, words_of
from mnemoframe.llm.leaks import leaked_items
from mnemoframe.llm.mixing import mix_report, weighted_mix, with_tokens
from mnemoframe.llm.nearest import latest_vectors, measured_loss, nearest_vectors
from mnemoframe.llm.spans import document_spans, shared_amounts, sharing_pairs, without_shared_spans
from mnemoframe.llm.together import items_together
from mnemoframe.plans.memory_logs import name_sql
from mnemoframe.plans.tables import table

CATALOG = Catalog()

#: Least similarity of a match between two files.
MATCH = 0.85

_GROUPS_SQL = f"""
named AS (SELECT {name_sql("new_file")} AS x, {name_sql("existing_file")} AS y, similarity AS s FROM conflicts WHERE similarity IS NOT NULL AND NOT isnan(similarity)),
links AS (SELECT DISTINCT x, y FROM named WHERE x <> y AND (CASE WHEN s > 1 THEN s / 100 ELSE s END) >= {MATCH}),
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM sides UNION SELECT reach.x, sides.y FROM reach JOIN sides ON reach.y = sides.x),
grouped AS (SELECT x AS filename, least(x, min(y)) AS group_file FROM reach GROUP BY x)
"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("similarity")
    score = F.when(F.isnan(score), None).when(score > 1, score / F.lit(100.0)).otherwise(score)
    rows = table(spark, folder, "conflicts").where(score >= MATCH)
    return connected_groups(rows, common_file_name("new_file"), common_file_name("existing_file")).select(F.col("group").alias("group_file"), F.col("member").alias("filename"))


@CATALOG.query("p2_found", f"WITH RECURSIVE {_GROUPS_SQL} SELECT group_file, filename FROM grouped")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that sufficiently similar conflicts link, with their group's first file."""
    return _groups(spark, folder)


@CATALOG.query("p2_group_sizes", f"WITH RECURSIVE {_GROUPS_SQL} SELECT group_file, count(*) AS members, max(filename) AS last_file FROM grouped GROUP BY group_file")
def p2_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Each group with its number of members."""
    return _groups(spark, folder).groupBy("group_file").agg(F.count("*").alias("members"), F.max("filename").alias("last_file"))


_TOGETHER_SQL = f"""
e AS (SELECT DISTINCT session_id, second, file FROM (SELECT session_id, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS second, {name_sql("filename")} AS file
  FROM access_log WHERE ts > 0 AND trim(session_id) <> '') WHERE file IS NOT NULL),
n AS (SELECT count(*) AS n_baskets FROM (SELECT DISTINCT session_id, second FROM e)),
c AS (SELECT file, count(*) AS n FROM e GROUP BY file),
p AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS n_ab FROM e x JOIN e y ON x.session_id = y.session_id AND x.second = y.second AND x.file < y.file GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT file_a, file_b, n_ab, a.n AS n_a, b.n AS n_b, n_baskets, n_ab::DOUBLE * n_baskets / (a.n::DOUBLE * b.n) AS ratio FROM p JOIN c a ON file_a = a.file JOIN c b ON file_b = b.file, n WHERE n_ab * n_baskets >= 3 * a.n * b.n)
"""


def _together(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "access_log").select(common_file_name("filename").alias("file"), epoch_second("ts").alias("second"), "session_id")
    return items_together(log.where(trimmed("session_id") != ""), ["session_id", "second"], "file")


@CATALOG.query("p4_found", f"WITH {_TOGETHER_SQL} SELECT file_a, file_b FROM t")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files recalled in one batch at least five times and three times as often as by chance."""
    return _together(spark, folder).select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


@CATALOG.query("p4_beside_co_recall", f"""WITH {_TOGETHER_SQL},
r AS (SELECT least(a, b) AS file_a, greatest(a, b) AS file_b, max(weight) AS weight FROM (SELECT {name_sql("a")} AS a, {name_sql("b")} AS b, weight FROM co_recall) WHERE a <> b GROUP BY ALL)
SELECT file_a, file_b, n_ab, n_a, n_b, n_baskets, ratio, weight FROM t LEFT JOIN r USING (file_a, file_b)""")
def p4_beside_co_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with their counts and ratio, beside the greatest weight that co_recall has for them."""
    a, b = common_file_name("a"), common_file_name("b")
    weights = table(spark, folder, "co_recall").where(a != b).groupBy(F.least(a, b).alias("file_a"), F.greatest(a, b).alias("file_b")).agg(F.max("weight").alias("weight"))
    pairs = _together(spark, folder).withColumnsRenamed({"item_a": "file_a", "item_b": "file_b"})
    return pairs.join(weights, ["file_a", "file_b"], "left").select("file_a", "file_b", "n_ab", "n_a", "n_b", "n_baskets", "ratio", "weight")


#: Least cosine of a pair of p5_found, and neighbours looked for.
SIMILAR, NEIGHBOURS = 0.80, 5

_NEAREST_SQL = f"""
v AS (SELECT {name_sql("filename")} AS file, mtime, model, dim, vector FROM memory_vectors),
m AS (SELECT file, max(mtime) AS mtime FROM v GROUP BY file),
u AS (SELECT DISTINCT file, model, vector FROM v JOIN m USING (file, mtime) WHERE file IS NOT NULL AND model IS NOT NULL AND vector IS NOT NULL AND len(vector) = dim
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
p AS (SELECT x.file AS id, y.file AS other, list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]) AS similarity FROM u x JOIN u y ON x.model = y.model AND x.file <> y.file),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM p QUALIFY rank <= {NEIGHBOURS})
"""


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(latest_vectors(table(spark, folder, "memory_vectors"), common_file_name("filename")), "id", "model", "vector", NEIGHBOURS)


@CATALOG.query("p5_found", f"WITH {_NEAREST_SQL} SELECT DISTINCT least(id, other) AS file_a, greatest(id, other) AS file_b FROM k WHERE similarity >= {SIMILAR}")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files of one model with close vectors, one among the five nearest of the other."""
    close = _nearest(spark, folder).where(F.col("similarity") >= SIMILAR)
    return close.select(F.least("id", "other").alias("file_a"), F.greatest("id", "other").alias("file_b")).distinct()


@CATALOG.query("p5_nearest")
def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar files of every file, as found by the index."""
    return _nearest(spark, folder).select(F.col("id").alias("filename"), F.col("other").alias("neighbour"), F.round("similarity", 6).alias("similarity"), "rank")


@CATALOG.query("p5_loss")
def p5_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the exact five nearest that the index finds, over every fiftieth file against all."""
    latest = latest_vectors(table(spark, folder, "memory_vectors"), common_file_name("filename"))
    return measured_loss(latest, _nearest(spark, folder), "id", "model", "vector", NEIGHBOURS)


_HISTORY_SQL = r"""
w AS (SELECT DISTINCT id, batch_no, list_distinct(regexp_extract_all(lower(coalesce(trigger, '') || ' ' || coalesce(action, '')), '[a-z0-9_]+')) AS s FROM heuristics WHERE id IS NOT NULL AND batch_no IS NOT NULL),
h AS (SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM w x JOIN w y ON x.id < y.id AND x.batch_no <> y.batch_no AND len(x.s) > 0 AND len(y.s) > 0
  AND len(x.s) >= 0.7 * len(y.s) AND len(y.s) >= 0.7 * len(x.s)
  WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE >= 0.7),
o AS (SELECT row_id, batch_no, CASE WHEN starts_with(lower(trim(dedup_hash, chr(10)||chr(9)||' ')), 'sha256:') THEN substr(lower(trim(dedup_hash, chr(10)||chr(9)||' ')), 8) ELSE lower(trim(dedup_hash, chr(10)||chr(9)||' ')) END AS k,
  array_to_string([trim(regexp_replace(regexp_replace(lower(coalesce(x, '')), '["''`‘’“”]', '', 'g'), '\s+', ' ', 'g')) FOR x IN [subject, predicate, object, kind]], chr(31)) AS f FROM observation_corroboration),
f AS (SELECT f, min(k) AS known FROM o WHERE k IS NOT NULL GROUP BY f),
c AS (SELECT row_id, batch_no, coalesce('k' || k, 'k' || known, 'f' || o.f) AS record FROM o LEFT JOIN f ON o.f = f.f),
s AS (SELECT record, min(row_id) AS first_id, arg_min(batch_no, row_id) AS first_batch FROM c GROUP BY record)
"""


def _record_key() -> tuple[Column, Column]:
    """The normal form of the stored hash, and what stands for a record without one."""
    stored = F.lower(trimmed("dedup_hash"))
    key = F.when(stored.startswith("sha256:"), F.substring(stored, 8, 1 << 30)).otherwise(stored)
    plain = lambda c: trimmed(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "\"'`‘’“”", ""), r"[\s\x{85}\x{a0}]+", " "))
    return key, F.concat_ws("\x1f", *[plain(F.col(c)) for c in ("subject", "predicate", "object", "kind")])


@CATALOG.query("p6_found", f"WITH {_HISTORY_SQL} SELECT 'heuristics' AS rec_table, id_a, id_b FROM h UNION SELECT DISTINCT 'observation_corroboration', first_id, row_id FROM c JOIN s USING (record) WHERE batch_no > first_batch AND row_id > first_id")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a batch that repeat or nearly repeat one of another batch."""
    near = near_duplicates_of_history(table(spark, folder, "heuristics"), "id", "batch_no", words_of("trigger", "action"), 0.7)
    same = repeated_records(table(spark, folder, "observation_corroboration"), "row_id", "batch_no", *_record_key())
    return near.select(F.lit("heuristics").alias("rec_table"), "id_a", "id_b").unionByName(same.select(F.lit("observation_corroboration").alias("rec_table"), "id_a", "id_b"))


_LEAKS_SQL = """
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
ip AS (SELECT DISTINCT item_id, least(12, len(w)) AS k, unnest(list_transform(range(1, greatest(2, len(w) - 10)), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS p FROM iw WHERE len(w) > 0),
dp AS (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 10)), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS p FROM dw WHERE len(w) > 0),
leaks AS (SELECT doc_id, item_id FROM dp JOIN ip USING (p) WHERE k = 12
  UNION SELECT doc_id, item_id FROM dw JOIN (SELECT item_id, p FROM ip WHERE k < 12) ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' '))
"""


@CATALOG.query("p7_found", f"WITH {_LEAKS_SQL} SELECT doc_id, item_id FROM leaks")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@CATALOG.query("p7_leaked_items", f"WITH {_LEAKS_SQL} SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM leaks GROUP BY item_id")
def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """The test items that leaked, with the number of documents that hold part of them."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_mix(with_tokens(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


@CATALOG.query("p8_mixture")
def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture in their order, as often as they are repeated."""
    return _mix(spark, folder)


@CATALOG.query("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix_report(_mix(spark, folder), table(spark, folder, "mix_targets"))


#: Characters of a long span.
SPAN = 240

_SPANS_SQL = f"""
t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {SPAN}),
g AS (SELECT doc_id, i, md5(substr(text, i + 1, {SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - {SPAN - 1})) AS i FROM t)),
shared AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT DISTINCT doc_id, i FROM g JOIN shared USING (h)),
islands AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM starts),
spans AS (SELECT doc_id, min(i) AS "begin", max(i) + {SPAN} AS "end" FROM islands GROUP BY doc_id, island),
chars AS (SELECT DISTINCT doc_id, unnest(range("begin", "end")) AS c FROM spans)
"""


@CATALOG.query("p9_found", f"WITH {_SPANS_SQL} SELECT DISTINCT x.doc_id AS doc_a, y.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, h FROM g JOIN shared USING (h)) x JOIN (SELECT DISTINCT doc_id, h FROM g JOIN shared USING (h)) y ON x.h = y.h AND x.doc_id < y.doc_id")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a long span in common."""
    return sharing_pairs(table(spark, folder, "documents"), SPAN)


@CATALOG.query("p9_shared_amounts", f"WITH {_SPANS_SQL} SELECT doc_id, max(length(text)) AS n_chars, any_value(stretches) AS stretches, any_value(n) AS shared_chars FROM documents JOIN (SELECT doc_id, count(*) AS stretches FROM spans GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM chars GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def p9_shared_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document recurs verbatim in others."""
    return shared_amounts(table(spark, folder, "documents"), SPAN)


@CATALOG.query("p9_spans", f'WITH {_SPANS_SQL} SELECT doc_id, "begin", "end" FROM spans')
def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each document that recur verbatim in others."""
    return document_spans(table(spark, folder, "documents"), SPAN)


@CATALOG.query("p9_rest", f"WITH {_SPANS_SQL} SELECT doc_id, length(text) AS n_chars, length(text) - coalesce(n, 0) AS chars_left FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chars GROUP BY doc_id) USING (doc_id) WHERE doc_id IS NOT NULL")
def p9_rest(spark: SparkSession, folder: str) -> DataFrame:
    """How long each document is, and how long without its stretches."""
    docs = table(spark, folder, "documents")
    left = without_shared_spans(docs, SPAN).select("doc_id", F.length("text").alias("chars_left"))
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.length("text").alias("n_chars")).join(left, "doc_id")
