"""Writers: append logs, index texts, header edits, graduation of candidates, migrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.durable import exists
from mnemoframe.functions.text import col, slug
from mnemoframe.operators.audits import incomplete
from mnemoframe.sources.readers import FRONT_MATTER, comma_list, front_matter

# Formats that results depend on.
MARK_START, MARK_END = "<!-- AUTO-INDEX-START -->", "<!-- AUTO-INDEX-END -->"
BUCKETS = (
    ("self", "Self (continuity / phenomenology)"), ("user", "User Context Memories"), ("feedback", "Feedback (operating preferences)"), ("project", "Projects"),
    ("digest", "Weekly Digests"), ("session", "Session Handoffs"), ("config", "Configuration"), ("", "Untyped"),
)
TYPED = ("self", "user", "feedback", "project", "digest", "config")
PREFIXED = ("self", "user", "feedback", "digest")


def append(rows: DataFrame, path: str, by: Sequence[str] = (), format: str = "parquet") -> None:
    """Append rows to a log, partitioned where asked."""
    writer = rows.write.mode("append").format(format)
    (writer.partitionBy(*by) if by else writer).save(path)


def rebuild(rows: DataFrame, path: str) -> None:
    """Replace a derived table as a whole."""
    rows.write.mode("overwrite").parquet(path)


def index_bucket(type_: Column | str, filename: Column | str) -> Column:
    """The index bucket: the type if it has one, else by the name's prefix, else untyped."""
    t, name = F.lower(F.coalesce(col(type_), F.lit(""))), F.lower(col(filename))
    out = F.when(t.isin(list(TYPED)), t)
    for p in PREFIXED:
        out = out.when(F.startswith(name, F.lit(f"{p}_")), p)
    return out.when(F.startswith(name, F.lit("session_handoff")), "session").otherwise("")


def index_lines(files: DataFrame) -> DataFrame:
    """``bucket, place, line``: the index's entries in order. ``files`` has ``filename, name, description, type, weight``."""
    text = F.btrim(F.replace(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("name"), F.lit("")), F.lit("\n"), F.lit(" ")))
    tag = F.when(F.lower("weight") == "high", F.concat(F.lit("  *[weight: "), F.col("weight"), F.lit("]*"))).otherwise("")
    line = F.concat(F.lit("- `"), F.col("filename"), F.lit("` — "), text, tag)
    rows = files.select(index_bucket("type", "filename").alias("bucket"), "filename", line.alias("line"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("filename", "line"))).select("bucket", "place", "line")


def rendered_index(files: DataFrame, generated: str) -> str:
    """The index text for the driver to write; streams the entries in order, bucket by bucket."""
    lines = index_lines(files)
    counts = {r["bucket"]: r["n"] for r in lines.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    out = ["", "## Auto-Indexed Memories", "", f"_Generated {generated}._", "", f"**Total memories indexed:** {sum(counts.values())}", ""]
    for key, label in BUCKETS:
        if counts.get(key):
            out += [f"### {label} ({counts[key]})", ""]
            out += [r["line"] for r in lines.where(F.col("bucket") == key).orderBy("place").toLocalIterator()]
            out.append("")
    return "\n".join(out).rstrip() + "\n"


def spliced(current: Column | str, block: Column | str) -> Column:
    """The text with what is between the marks replaced, or the marked block appended."""
    current, marked = F.coalesce(col(current), F.lit("")), F.concat(F.lit(MARK_START + "\n"), col(block), F.lit("\n" + MARK_END + "\n"))
    has = F.contains(current, F.lit(MARK_START)) & F.contains(current, F.lit(MARK_END))
    before, after = F.substring_index(current, MARK_START, 1), F.regexp_extract(current, f"(?s){MARK_START}.*?{MARK_END}\\n?(.*)$", 1)
    gap = F.when(F.endswith(current, F.lit("\n")), "").otherwise("\n")
    return F.when(has, F.concat(before, marked, after)).otherwise(F.concat(current, gap, F.lit("\n---\n\n"), marked))


def with_related(content: Column | str, links: Column | str) -> Column:
    """The text with links added to its header's ``related`` list, which is made if lacking; without header it stays as it is."""
    content, links = col(content), col(links)
    have = comma_list(F.try_element_at(front_matter(content), F.lit("related")))
    line = F.concat(F.lit("related: "), F.array_join(F.array_union(have, links), ", "))
    block = F.regexp_extract(content, FRONT_MATTER, 1)
    rest = F.regexp_extract(content, FRONT_MATTER, 2)
    replaced = F.when(block.rlike(r"(?m)^related:"), F.array_join(F.transform(F.split(block, "\n"), lambda x: F.when(x.rlike("^related:"), line).otherwise(x)), "\n")).otherwise(F.concat(block, F.lit("\n"), line))
    return F.when(content.rlike(FRONT_MATTER) & (F.size(links) > 0), F.concat(F.lit("---\n"), replaced, F.lit("\n---\n"), rest)).otherwise(content)


def bumped(content: Column | str, day: str) -> Column:
    """The header's ``corroborations`` counter one higher, with the day; without header the text stays."""
    content = col(content)
    count = F.coalesce(F.nullif(F.regexp_extract(content, r"(?m)^corroborations:\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)) + 1
    lines = F.concat(F.lit("corroborations: "), count.cast("string"), F.lit(f"\nlast_corroborated: {day}"))
    block = F.regexp_replace(F.regexp_extract(content, FRONT_MATTER, 1), r"(?m)^(corroborations|last_corroborated):[^\n]*\n?", "")
    head = F.rtrim(block, F.lit("\n"))
    return F.when(content.rlike(FRONT_MATTER), F.concat(F.lit("---\n"), head, F.lit("\n"), lines, F.lit("\n---\n"), F.regexp_extract(content, FRONT_MATTER, 2))).otherwise(content)


def graduations(candidates: DataFrame, taken: DataFrame, least_score: float, prefix: str = "session") -> DataFrame:
    """``path, filename, obs_ids, graduates``: which candidates pass, and the free file name of each.

    A candidate passes with its score, row ids and topic. Names are taken in order of
    generation; a taken name gets the next number.
    """
    name = F.concat(F.lit(f"{prefix}_"), slug("topic", "_", 40))
    passes = (F.col("cluster_score") >= least_score) & (F.size("obs_ids") > 0) & (F.col("topic") != "(no clear topic)")
    rows = candidates.select("path", "obs_ids", "generated_at", name.alias("stem"), passes.alias("graduates"))
    used = taken.select(F.regexp_replace("filename", r"(_\d+)?\.md$", "").alias("stem")).groupBy("stem").agg(F.count("*").alias("used"))
    order = F.row_number().over(Window.partitionBy("stem", "graduates").orderBy("generated_at", "path"))
    numbered = rows.withColumn("_n", order).join(used, "stem", "left").withColumn("_n", F.col("_n") + F.coalesce("used", F.lit(0)))
    full = F.when(F.col("_n") == 1, F.concat("stem", F.lit(".md"))).otherwise(F.concat("stem", F.lit("_"), F.col("_n").cast("string"), F.lit(".md")))
    return numbered.select("path", F.when(F.col("graduates"), full).alias("filename"), "obs_ids", "graduates")


def complete(files: DataFrame) -> DataFrame:
    """Files that lack a required header field, with what they lack."""
    return incomplete(files, ("name", "description", "type", "weight"))


def migrate(spark: SparkSession, path: str, steps: Sequence[tuple[str, Callable[[], int]]]) -> list[str]:
    """Runs each named step once: those in the log at ``path`` are skipped; returns the names that ran.

    Without a log nothing ran yet; a log that can't be read is an error, as steps would run twice.
    """
    done = {r["name"] for r in spark.read.json(path, schema="name string, rows long").select("name").collect()} if exists(spark, path) else set()
    ran = []
    for name, step in steps:
        if name in done:
            continue
        rows = step()
        append(spark.createDataFrame([(name, int(rows))], "name string, rows long"), path, format="json")
        ran.append(name)
    return ran


def with_columns(table: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """Adds the columns that a table lacks, as nulls: additive schema evolution."""
    return table.withColumns({name: F.lit(None).cast(kind) for name, kind in ddl.items() if name not in table.columns})


def month_buckets(rows: DataFrame, at: Column) -> DataFrame:
    """Adds ``month`` (``YYYY-MM``) by which old logs are packed; without time ``unknown``."""
    return rows.withColumn("month", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown")))
