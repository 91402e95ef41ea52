"""Readers: memories with front matter, JSON lines, indexes, sections, lists, probes, candidates.

Whole-text readers give ``path, filename, content, mtime``. The parsers take a DataFrame with
``content`` and are expressions, so that they serve files, tables and streams alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.durable import exists
from mnemoframe.functions.text import col

# Formats that results depend on.
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
INDEX_LINK = r"\[([^\]]+)\]\(([^)]+\.md)\)"
INDEX_BACKTICK = r"`([^`]+\.md)`"
THREAD_LINE = r"^- \[([ x])\] (t\d+) — (.+)$"
THREAD_OPENED = r" _\(opened (\d{4}-\d{2}-\d{2})\)_\s*$"
PROBE_RESPONSE = r"(?s)##\s+Response.*?\n+```[a-zA-Z]*\n(.*?)\n```"
EPILOGUE_SECTIONS = ("What we built / did", "What mattered", "What surprised", "Functional states", "Open threads", "A note to next-me")
CANDIDATE_FIELDS = {
    "obs_ids": r"source_obs_ids:\s*(\[.*?\])", "recommended": r"## Recommended memory file\s*\n`(.+?)`", "cluster_score": r"cluster_score:\s*([0-9.]+)",
    "generated_at": r"generated_at:\s*(\d+)", "source_session": r"source_session:\s*(\S+)", "topic": r"## Topic\s*\n(.+)", "top_file": r"## Files involved\s*\n- `(.+?)`",
}

LINE_END = "\r\n|\n|\r"


def lines_of(content: Column | str) -> Column:
    return F.split(col(content), LINE_END)


def read_texts(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.md", skip: Sequence[str] = ()) -> DataFrame:
    """Whole texts of a folder as ``path, filename, content, mtime``, the skipped names left out.

    Bytes that are no UTF-8 become replacement characters. Files of no bytes are no rows: Spark's listing leaves them out.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    rows = reader.load(path).select(
        "path", F.substring_index("path", "/", -1).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"),
    )
    return rows.where(~F.col("filename").isin(list(skip))) if skip else rows


def front_matter(content: Column | str, strict: bool = False) -> Column:
    """The header as a map; no header gives an empty map.

    A line's first colon splits it, the last of repeated keys wins, other lines are ignored.
    ``strict`` takes only identifiers as keys and strips quote marks from values.
    """
    block = F.regexp_extract(F.coalesce(col(content), F.lit("")), FRONT_MATTER, 1)
    wanted = r"^[A-Za-z_][A-Za-z0-9_]*\s*:" if strict else ":"
    fields = F.filter(lines_of(block), lambda x: x.rlike(wanted))
    value = lambda x: F.btrim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))
    entries = F.transform(fields, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), (F.btrim(value(x), F.lit("\"' ")) if strict else value(x)).alias("v")))
    # The last of equal keys: those are left out that a later entry repeats.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def body_of(content: Column | str) -> Column:
    """What follows the header; all of it where there is no header."""
    content = F.coalesce(col(content), F.lit(""))
    return F.when(content.rlike(FRONT_MATTER), F.regexp_extract(content, FRONT_MATTER, 2)).otherwise(content)


def comma_list(text: Column | str) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def memories(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Memories of whole texts: header fields, related files, body; the name is the file's stem by default."""
    rows = texts.withColumn("fields", front_matter("content", strict))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.select(
        "filename", F.coalesce(field("name"), F.regexp_replace("filename", r"\.md$", "")).alias("name"),
        *[F.coalesce(field(k), F.lit("")).alias(k) for k in ("description", "type", "weight")],
        *[F.nullif(field(k), F.lit("")).alias(k) for k in ("expires", "created", "event_date")],
        comma_list(field("related")).alias("related"), body_of("content").alias("body"), F.col("fields").alias("raw_frontmatter"), "mtime",
    )


def read_memories(spark: SparkSession, path: str, index_name: str = "MEMORY.md", strict: bool = False) -> DataFrame:
    return memories(read_texts(spark, path, skip=(index_name,)), strict)


def read_json_lines(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON lines log, and its torn lines. Lines that are no objects are torn."""
    raw = spark.read.text(path).where(F.btrim("value") != "")
    return parsed_json_lines(raw, ddl)


def parsed_json_lines(raw: DataFrame, ddl: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_json_lines`, of a table with the lines in ``value``."""
    good = F.btrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    rows = raw.withColumn("_good", F.coalesce(good, F.lit(False)))
    return rows.where("_good").select(F.from_json("value", ddl).alias("r")).select("r.*"), rows.where("NOT _good").select("value")


def index_entries(content: DataFrame, key: str | None = None) -> DataFrame:
    """``key?, title, filename, description, line`` of an index text: the link form wins over backticks, a file's first entry stays."""
    keys = [key] if key else []
    rows = content.select(*keys, F.posexplode(lines_of("content")).alias("line", "text"))
    link, tick = F.regexp_extract("text", INDEX_LINK, 2), F.regexp_extract("text", INDEX_BACKTICK, 1)
    filename = F.when(link != "", link).otherwise(tick)
    whole = F.when(link != "", F.regexp_extract("text", INDEX_LINK, 0)).otherwise(F.regexp_extract("text", INDEX_BACKTICK, 0))
    tail = F.expr("substr(text, instr(text, _whole) + length(_whole))")
    found = rows.withColumn("filename", filename).where("filename <> ''").withColumn("_whole", whole).withColumn("title", F.when(link != "", F.regexp_extract("text", INDEX_LINK, 1)).otherwise(tick))
    strip = F.when(link != "", F.regexp_replace(tail, "^[ —-]+", "")).otherwise(F.regexp_replace(tail, "^[ —:-]+", ""))
    found = found.withColumn("description", F.btrim(strip))
    first = F.row_number().over(Window.partitionBy(*keys, "filename").orderBy("line"))
    return found.withColumn("_n", first).where("_n = 1").select(*keys, "title", "filename", "description", "line")


def sections(texts: DataFrame, key: str, content: str = "content", names: Sequence[str] = EPILOGUE_SECTIONS) -> DataFrame:
    """``key, section, text``: lines below a ``##`` heading that holds a section's name, up to the next such heading.

    Names are compared without case, the first in the list that fits wins. Other headings are
    text. A section that comes twice has its last text. Empty sections are left out.
    """
    rows = texts.select(F.col(key).alias("key"), F.posexplode(lines_of(content)).alias("n", "line"))
    heading = F.when(F.startswith("line", F.lit("##")), F.lower("line"))
    named = F.coalesce(*[F.when(F.contains(heading, F.lit(s.lower())), F.lit(s)) for s in names])
    order = Window.partitionBy("key").orderBy("n")
    rows = rows.withColumn("_named", named)
    rows = rows.withColumn("_begin", F.last(F.when(F.col("_named").isNotNull(), F.struct(F.col("n").alias("n"), F.col("_named").alias("s"))), ignorenulls=True).over(order))
    inside = rows.where(F.col("_begin").isNotNull() & F.col("_named").isNull())
    joined = inside.groupBy("key", F.col("_begin.s").alias("section"), F.col("_begin.n").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    last = joined.groupBy("key", "section").agg(F.max_by("text", "at").alias("text"))
    return last.select("key", "section", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def threads(texts: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, id, done, body, opened`` of a list of open threads."""
    rows = texts.select(F.col(key).alias("key"), F.explode(lines_of(content)).alias("line")).where(F.col("line").rlike(THREAD_LINE))
    rest = F.regexp_extract("line", THREAD_LINE, 3)
    return rows.select(
        "key", F.regexp_extract("line", THREAD_LINE, 2).alias("id"), (F.regexp_extract("line", THREAD_LINE, 1) == "x").alias("done"),
        F.btrim(F.regexp_replace(rest, THREAD_OPENED, "")).alias("body"), F.nullif(F.regexp_extract(rest, THREAD_OPENED, 1), F.lit("")).alias("opened"),
    )


def probes(texts: DataFrame) -> DataFrame:
    """``slug, date, probe_type, result, response`` of probe texts ``filename, content``."""
    rows = texts.withColumn("_f", front_matter("content"))
    field = lambda k: F.try_element_at("_f", F.lit(k))
    return rows.select(
        F.regexp_replace("filename", r"\.md$", "").alias("slug"), F.coalesce(field("date"), F.lit("")).alias("date"), F.coalesce(field("probe_type"), F.lit("")).alias("probe_type"),
        F.coalesce(field("result"), F.lit("")).alias("result"), F.regexp_extract("content", PROBE_RESPONSE, 1).alias("response"),
    )


def candidates(texts: DataFrame, key: str = "path") -> DataFrame:
    """Fields of candidate texts; texts without row ids or a recommended file are none."""
    found = {k: F.regexp_extract("content", p, 1) for k, p in CANDIDATE_FIELDS.items()}
    ids = F.from_json(found["obs_ids"], "array<bigint>")
    return texts.where((found["obs_ids"] != "") & (found["recommended"] != "") & ids.isNotNull()).select(
        key, ids.alias("obs_ids"), F.btrim(found["recommended"]).alias("recommended"), F.coalesce(F.nullif(found["cluster_score"], F.lit("")).try_cast("double"), F.lit(0.0)).alias("cluster_score"),
        F.coalesce(F.nullif(found["generated_at"], F.lit("")).try_cast("bigint"), F.lit(0)).alias("generated_at"), F.coalesce(F.nullif(found["source_session"], F.lit("")), F.lit("?")).alias("source_session"),
        F.coalesce(F.nullif(F.btrim(found["topic"]), F.lit("")), F.lit("(no clear topic)")).alias("topic"), F.btrim(found["top_file"]).alias("top_file"),
    )


def pending(texts: DataFrame, resolved: Sequence[str] = ("archived", "promoted", "rejected")) -> DataFrame:
    """Files below a folder that aren't in any folder of resolved ones."""
    return texts.where(~F.arrays_overlap(F.split("path", "/"), F.lit(list(resolved))))


def hook_payload(raw: Column | str, fields: dict[str, tuple[str, str]]) -> Column:
    """A struct of a hook's JSON: for each name the first non-empty of its two spellings."""
    parsed = F.from_json(col(raw), "map<string,string>")
    pick = lambda pair: F.coalesce(*[F.nullif(F.try_element_at(parsed, F.lit(k)), F.lit("")) for k in pair])
    return F.struct(*[pick(pair).alias(name) for name, pair in fields.items()])


def tool_paths(tool_input: Column | str) -> Column:
    """File paths in a tool's JSON input, in five shapes, each once: path keys, a list of files, a list of edits."""
    j = F.from_json(col(tool_input), "file_path string, path string, notebook_path string, files array<string>, edits array<struct<file_path:string>>")
    single = F.array(j["file_path"], j["path"], j["notebook_path"])
    many = F.concat(single, F.coalesce(j["files"], F.array().cast("array<string>")), F.coalesce(j["edits"]["file_path"], F.array().cast("array<string>")))
    return F.array_distinct(F.filter(many, lambda p: p.isNotNull() & (p != "")))


def first_json(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """Rows of the first path that exists and holds JSON only (seeds, cases, flags); none gives an empty table.

    A path that is there but can't be read is an error.
    """
    for path in paths:
        if exists(spark, path):
            texts = spark.read.text(path, wholetext=True)
            if texts.where(F.try_parse_json("value").isNull()).isEmpty():
                return spark.read.schema(ddl).option("multiLine", True).json(path)
    return spark.createDataFrame([], ddl)
