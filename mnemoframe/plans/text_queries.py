"""Queries of the scalar library and the text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.catalog import Catalog
from mnemoframe.functions import text as T
from mnemoframe.functions.names import trimmed
from mnemoframe.operators import lexical
from mnemoframe.plans import views as V
from mnemoframe.plans.tables import table
from mnemoframe.sources import readers, writers

CATALOG = Catalog()
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@CATALOG.query("token_counts", f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def token_counts(spark, d):
    words = T.tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@CATALOG.query("idf_table", f"WITH w AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)::DOUBLE) + 1, 6) AS idf FROM w, n GROUP BY term")
def idf_table(spark, d):
    return lexical.idf_table(table(spark, d, "documents"), "text").withColumn("idf", F.round("idf", 6))


_NORM = "regexp_replace(translate(trim(lower(coalesce({0}, ''))), '\"''`‘’“”', ''), '\\s+', ' ', 'g')"


@CATALOG.query("normalised_subjects", f"SELECT DISTINCT row_id, {_NORM.format('subject')} AS subject FROM observation_corroboration")
def normalised_subjects(spark, d):
    return table(spark, d, "observation_corroboration").select("row_id", T.normalised("subject").alias("subject")).distinct()


_JSON = " || ".join(["'{'"] + [f"""'{'' if i == 0 else ','}"{c}":"' || replace(replace({_NORM.format(c)}, '\\', '\\\\'), '"', '\\"') || '"'""" for i, c in enumerate(("kind", "object", "predicate", "subject"))] + ["'}'"])


@CATALOG.query("record_hashes", f"SELECT DISTINCT row_id, 'sha256:' || substr(sha256({_JSON}), 1, 32) AS record_hash FROM observation_corroboration")
def record_hashes(spark, d):
    return table(spark, d, "observation_corroboration").select("row_id", T.record_hash("subject", "predicate", "object", "kind").alias("record_hash")).distinct()


@CATALOG.query("content_hashes", "SELECT doc_id, substr(md5(coalesce(source, '') || coalesce(lang, '') || coalesce(text, '')), 1, 16) AS plain, substr(md5(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')), 1, 16) AS lined, substr(sha256(text), 1, 16) AS version FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash("source", "lang", "text").alias("plain"), T.content_hash("source", "lang", "text", separator="\n").alias("lined"), T.text_hash("text").alias("version"))


@CATALOG.query("event_hashes", "SELECT id, 'sha256:' || substr(sha256(created_ts || '|' || coalesce(source_session, '') || '|' || coalesce(origin, '') || '|' || coalesce(trigger, '')), 1, 32) AS event_id FROM heuristics WHERE created_ts IS NOT NULL")
def event_hashes(spark, d):
    rows = table(spark, d, "heuristics").where("created_ts IS NOT NULL")
    return rows.select("id", T.event_hash(F.col("created_ts").cast("string"), "source_session", "origin", "trigger").alias("event_id"))


def _slug_sql(c, filler, most, empty):
    bare = f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_-]+', '{filler}', 'g'), '{filler}')"
    return f"coalesce(nullif(substr({bare}, 1, {most}), ''), '{empty}')"


@CATALOG.query("slugs", f"SELECT id, {_slug_sql('trigger', '-', 50, 'candidate')} AS dashed, {_slug_sql('trigger', '_', 40, 'draft')} AS underscored FROM heuristics")
def slugs(spark, d):
    return table(spark, d, "heuristics").select("id", T.slug("trigger").alias("dashed"), T.slug("trigger", "_", 40, "draft").alias("underscored"))


@CATALOG.query("basenames", "SELECT DISTINCT filename, regexp_extract(filename, '[^/\\\\]*$') AS base FROM memory_files WHERE filename IS NOT NULL")
def basenames(spark, d):
    return table(spark, d, "memory_files").where("filename IS NOT NULL").select("filename", T.basename("filename").alias("base")).distinct()


_SECS = "greatest(coalesce(last_seen - first_seen, 1), 1)"


@CATALOG.query("durations", f"SELECT DISTINCT row_id, CASE WHEN {_SECS} >= 3600 THEN ({_SECS} // 3600) || 'h ' || ({_SECS} % 3600 // 60) || 'm' WHEN {_SECS} >= 60 THEN ({_SECS} // 60) || 'm ' || ({_SECS} % 60) || 's' ELSE {_SECS} || 's' END AS lasted FROM observation_corroboration")
def durations(spark, d):
    return table(spark, d, "observation_corroboration").select("row_id", T.duration(F.col("last_seen") - F.col("first_seen")).alias("lasted")).distinct()


@CATALOG.query("one_liners", "WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS line FROM f")
def one_liners(spark, d):
    return table(spark, d, "documents").select("doc_id", T.one_line("text", 80).alias("line"))


@CATALOG.query("iso_weeks", "SELECT o_orderkey, isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders")
def iso_weeks(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", T.iso_week(day).alias("week"), F.date_trunc("week", day).cast("date").alias("monday"))


@CATALOG.query("dates_in_texts", "SELECT doc_id, CAST(try_cast(nullif(regexp_extract(text, '(\\d{4}[-_]\\d{2}[-_]\\d{2})', 1), '') AS DATE) AS DATE) AS day FROM documents")
def dates_in_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.date_in_name("text").alias("day"))


_PARAS = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n\\s*\\r?\\n'), lambda p: trim(p)), lambda p: p <> '' AND p[1] <> '#')"


@CATALOG.query("first_paragraphs", f"SELECT doc_id, coalesce({_PARAS}[1], '') AS paragraph FROM documents")
def first_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_paragraph(F.coalesce("text", F.lit(""))).alias("paragraph"))


_LINES = "regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')"


@CATALOG.query("heading_previews", f"SELECT doc_id, substr(array_to_string(list_slice(list_filter({_LINES}, lambda x: regexp_matches(x, '^#{{1,6}} ')), 1, 8), ' / ') || ' | ' || trim(regexp_replace(array_to_string(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^#{{1,6}} ')), ' '), '\\s+', ' ', 'g')), 1, 400) AS preview FROM documents")
def heading_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", T.heading_preview(F.coalesce("text", F.lit(""))).alias("preview"))


_SECRETS = "text"
for _s in T.SECRET_SHAPES:
    _SECRETS = f"regexp_replace({_SECRETS}, '{_s}', '[REDACTED]', 'g')"


@CATALOG.query("redactions", f"SELECT doc_id, md5({_SECRETS}) AS redacted, regexp_matches(lower(text), '{'|'.join(w for w in T.CREDENTIAL_WORDS)}') AS credential FROM documents WHERE text IS NOT NULL")
def redactions(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.redacted("text")).alias("redacted"), T.names_credential("text").alias("credential"))


#: What each path is made to end or begin with, so that every glob has paths that match it; ``{}`` is the path.
_PATHS = ("{}", "{}.env", "{}.env.local", "a/credentials-{}", "a/.credentials.d", "b/.git/objects/{}", "node_modules/{}", "c/node_modules/{}", "c/__pycache__/{}", "{}.key", "{}.pem", "~/.ssh/{}", "/h/.gnupg/{}", "{}.bash_history", "{}.bak-pre-7", "{}/environment.md", "x.keys/{}", "node_modules.md")
_PATHS_SQL = "CASE doc_id % " + str(len(_PATHS)) + " ".join(f" WHEN {i} THEN replace('{p}', '{{}}', path)" for i, p in enumerate(_PATHS)) + " END"


@CATALOG.query("excluded_paths", rf"""WITH p AS (SELECT doc_id, {_PATHS_SQL} AS path FROM documents WHERE path IS NOT NULL), b AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS base FROM p)
SELECT doc_id, path, base GLOB '*.env' OR base GLOB '*.env.*' OR base GLOB '*.key' OR base GLOB '*.pem' OR base GLOB '*history' OR base GLOB '*.bak-pre-*'
  OR regexp_matches(path, '(^|/)\.?credentials[^/]*$') OR regexp_matches(path, '(^|/)(\.git/objects|node_modules|__pycache__|\.ssh|\.gnupg)/') AS excluded FROM b""")
def excluded_paths(spark, d):
    kind = F.pmod("doc_id", F.lit(len(_PATHS)))
    path = F.coalesce(*[F.when(kind == i, F.replace(F.lit(p), F.lit("{}"), F.col("path"))) for i, p in enumerate(_PATHS)])
    rows = table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", T.path_excluded("path").alias("excluded"))


@CATALOG.query("error_flags", f"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?m)^\\s*(Traceback \\(most recent call last\\)|[A-Z][A-Za-z]*(Error|Exception)[:\\s])') OR regexp_matches(coalesce(text, ''), '{T.ERROR_PHRASE}') OR contains(coalesce(text, ''), 'tool_use_error') AS failed FROM documents")
def error_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_like_error("text").alias("failed"))


_CHAT = " OR ".join(["contains(lower(t), '" + s.replace("'", "''") + "')" for s in (*T.STRUCTURED_KEYS, *T.CHAT_SIGNALS)])


@CATALOG.query("document_likeness", f"WITH b AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents) SELECT doc_id, NOT (length(t) < 15 OR regexp_matches(t, '^[\\{{\\[]') OR (ends_with(t, '?') AND NOT contains(t, '.')) OR {_CHAT}) AS prose FROM b")
def document_likeness(spark, d):
    return table(spark, d, "documents").select("doc_id", T.reads_as_document("text").alias("prose"))


def _hits_sql(patterns):
    return "(" + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?mi){p}'))" for p in patterns) + ")"


@CATALOG.query("verification_verdicts", f"WITH h AS (SELECT doc_id, {_hits_sql(T.TEST_PASSED)} AS p, {_hits_sql(T.SMOKE)} AS s, {_hits_sql(T.TEST_RAN)} AS r, {_hits_sql(T.SHIPPED)} AS w FROM documents) SELECT doc_id, CASE WHEN p >= 1 OR (s >= 1 AND r >= 1) OR s >= 2 THEN 'true' WHEN w >= 1 THEN 'false' ELSE 'unknown' END AS verified FROM h")
def verification_verdicts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.verification_verdict("text").alias("verified"))


@CATALOG.query("snippets", f"SELECT doc_id, substr(trim(coalesce(list_filter({_LINES}, lambda x: contains(lower(x), 'checked'))[1], '')), 1, 200) AS line FROM documents WHERE text IS NOT NULL")
def snippets(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.first_line_with("text", F.lit("Checked")).alias("line"))


@CATALOG.query("byte_cuts", "SELECT doc_id, strlen(text) AS bytes, substr(text, 1, list_max(list_filter(range(0, 101), lambda i: strlen(substr(text, 1, i)) <= 100))) AS head FROM documents WHERE text IS NOT NULL")
def byte_cuts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), T.cut_bytes("text", 100).alias("head"))


@CATALOG.query("salvaged_json", "SELECT event_id, props AS found FROM events")
def salvaged_json(spark, d):
    reply = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    chatty = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked."))
    return table(spark, d, "events").select("event_id", T.salvaged_json(F.when(F.col("event_id") % 2 == 0, reply).otherwise(chatty)).alias("found"))


@CATALOG.query("front_matter", "WITH m AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n(.*)$', 1) AS h FROM documents) SELECT doc_id, regexp_extract(h, '(?m)^name: ([^\\r\\n]*)', 1) AS name, regexp_extract(h, '(?m)^type: ([^\\r\\n]*)', 1) AS type, h <> '' AS has_header FROM m")
def front_matter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", readers.front_matter("text").alias("f"), F.regexp_extract(F.coalesce("text", F.lit("")), readers.FRONT_MATTER, 1).alias("h"))
    field = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    return rows.select("doc_id", field("name").alias("name"), field("type").alias("type"), (F.col("h") != "").alias("has_header"))


@CATALOG.query("sections", f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM documents),
t AS (SELECT *, CASE WHEN starts_with(line, '##') AND contains(lower(line), 'done') THEN 'Done' WHEN starts_with(line, '##') AND contains(lower(line), 'next') THEN 'Next' END AS named FROM l),
r AS (SELECT *, max(CASE WHEN named IS NOT NULL THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM t),
j AS (SELECT r.doc_id, b.named AS section, r.pos, string_agg(r.line, chr(10) ORDER BY r.n) AS text FROM r JOIN t b ON b.doc_id = r.doc_id AND b.n = r.pos WHERE r.named IS NULL GROUP BY ALL),
u AS (SELECT doc_id, section, arg_max(text, pos) AS text FROM j GROUP BY ALL)
SELECT doc_id AS key, section, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM u WHERE text <> ''""")
def sections(spark, d):
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return readers.sections(rows, "doc_id", "text", ("Done", "Next"))


@CATALOG.query("index_entries", """WITH x AS (SELECT DISTINCT file, '- `' || file || '` — ' || coalesce(nullif(description, ''), name, '') AS line FROM files_) SELECT file AS filename, file AS title, trim(substr(line, length(file) + 8)) AS description FROM x""".replace("files_", f"(WITH {V.FILES_SQL} SELECT * FROM files WHERE file LIKE '%.md' AND file NOT LIKE '%`%')"))
def index_entries(spark, d):
    files = V.files(spark, d).where(F.col("file").endswith(".md") & ~F.contains("file", F.lit("`")))
    line = F.concat(F.lit("- `"), F.col("file"), F.lit("` — "), F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("name"), F.lit("")))
    return readers.index_entries(files.select("file", line.alias("content")), "file").select("filename", "title", "description")


_BUCKET = "CASE WHEN lower(coalesce(type, '')) IN ('self', 'user', 'feedback', 'project', 'digest', 'config') THEN lower(type) WHEN starts_with(file, 'self_') THEN 'self' WHEN starts_with(file, 'user_') THEN 'user' WHEN starts_with(file, 'feedback_') THEN 'feedback' WHEN starts_with(file, 'digest_') THEN 'digest' WHEN starts_with(file, 'session_handoff') THEN 'session' ELSE '' END"


@CATALOG.query("index_lines", f"""WITH {V.FILES_SQL}, l AS (SELECT {_BUCKET} AS bucket, file, '- `' || file || '` — ' || trim(replace(coalesce(nullif(description, ''), name, ''), chr(10), ' ')) || CASE WHEN weight = 'high' THEN '  *[weight: high]*' ELSE '' END AS line FROM files)
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY file, line) AS place, line FROM l""")
def index_lines(spark, d):
    return writers.index_lines(V.files(spark, d).withColumnRenamed("file", "filename"))


@CATALOG.query("month_buckets", "SELECT coalesce(strftime(written_at, '%Y-%m'), 'unknown') AS month, count(*) AS n FROM documents GROUP BY 1")
def month_buckets(spark, d):
    return writers.month_buckets(table(spark, d, "documents"), F.col("written_at")).groupBy("month").agg(F.count("*").alias("n"))


@CATALOG.query("session_topics", """WITH w AS (SELECT session_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_-]{2,}')) AS term FROM documents WHERE session_id IS NOT NULL),
s AS (SELECT * FROM w WHERE term NOT IN (""" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.SESSION_TOPIC_STOP_WORDS) + """)),
c AS (SELECT session_id, term, count(*) AS tf FROM s GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(DISTINCT session_id) AS n FROM documents),
k AS (SELECT session_id, term, round(tf * (ln(n / df::DOUBLE) + 1), 6) AS score, row_number() OVER (PARTITION BY session_id ORDER BY round(tf * (ln(n / df::DOUBLE) + 1), 10) DESC, term) AS rank FROM c JOIN f USING (term), n)
SELECT session_id, term, score, rank FROM k WHERE rank <= 10""")
def session_topics(spark, d):
    rows = table(spark, d, "documents").where("session_id IS NOT NULL")
    return lexical.tfidf_topics(rows, "session_id", T.topic_words("text", T.SESSION_TOPIC_STOP_WORDS)).withColumn("score", F.round("score", 6))


@CATALOG.query("source_terms", """WITH w AS (SELECT lower(trim(source)) AS source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_-]{2,}')) AS term FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, term, count(*) AS n FROM w WHERE term NOT IN (""" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.CANDIDATE_TOPIC_STOP_WORDS) + """) GROUP BY ALL)
SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 5""")
def source_terms(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL").withColumn("source", F.lower(F.btrim("source")))
    return lexical.top_terms(rows, "source", T.topic_words("text", T.CANDIDATE_TOPIC_STOP_WORDS))


@CATALOG.query("trimmed_sessions", "SELECT DISTINCT session_id, trim(session_id) AS bare FROM access_log WHERE session_id IS NOT NULL")
def trimmed_sessions(spark, d):
    return table(spark, d, "access_log").where("session_id IS NOT NULL").select("session_id", trimmed("session_id").alias("bare")).distinct()
