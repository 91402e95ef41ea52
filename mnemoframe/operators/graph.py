"""The knowledge graph: entities, bitemporal facts, neighbourhoods, ranking, extraction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release
from mnemoframe.functions.text import first_line_with
from mnemoframe.operators.lexical import contained_patterns, sized, top_ranked

# Constants that results depend on.
RESTART, ITERATIONS, EDGE_FLOOR, EDGE_HALF_LIFE = 0.15, 30, 0.05, 180.0
RANK_LEAST, RANK_MOST = 1e-4, 50
#: Nodes up to which ranking runs as one matrix on the driver's side of one task; the graph above runs as joins.
SMALL_GRAPH = 5000


def upserted_entities(sightings: DataFrame) -> DataFrame:
    """``name, type, aliases, first_seen, last_seen, confidence`` of sightings ``name, type, aliases, ts, confidence``.

    The key is name and type as they are; the greatest confidence stays, aliases are those of the
    first sighting (null aliases first among equal times). Null names or types don't count.
    """
    rows = sightings.where("name IS NOT NULL AND type IS NOT NULL")
    return rows.groupBy("name", "type").agg(
        F.min_by("aliases", "ts").alias("aliases"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("confidence").alias("confidence")
    )


def entities_named(entities: DataFrame, names: DataFrame) -> DataFrame:
    """``name, id``: for each looked-up name the smallest id of the entity so named in any case."""
    found = names.select("name", F.lower("name").alias("low")).distinct().join(entities.select("id", F.lower("name").alias("low")), "low")
    return found.groupBy("name").agg(F.min("id").alias("id"))


def listed_entities(entities: DataFrame, type_: str | None = None, k: int = 100) -> DataFrame:
    rows = entities if type_ is None else entities.where(F.col("type") == type_)
    return rows.orderBy(F.desc("confidence"), "id").limit(k)


def fact_intervals(facts: DataFrame) -> DataFrame:
    """Validity of functional facts ``subject, type, object, ts, seq``: each until the next with another object.

    Adds ``valid_from, valid_to, superseded_by`` (the next object). A fact that repeats the one
    before it refreshes it: the run is one row with the count ``asserted``. Ties in ``ts`` go by ``seq``. A fact
    whose object is its subject, in any case, is rejected. This is the replay in which a fact
    that comes back after another is a new one; see :func:`strict_fact_intervals`.
    """
    own = Window.partitionBy("subject", "type").orderBy("ts", "seq")
    kept = facts.where(F.lower(F.col("subject").cast("string")) != F.lower(F.col("object").cast("string")))
    runs = kept.withColumn("_new", F.when(F.lag("object").over(own).eqNullSafe(F.col("object")), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(own))
    rows = runs.groupBy("subject", "type", "_run").agg(F.first("object").alias("object"), F.min("ts").alias("valid_from"), F.min(F.struct("ts", "seq")).alias("_at"), F.count("*").alias("asserted"))
    after = Window.partitionBy("subject", "type").orderBy("_at")
    return rows.select("subject", "type", "object", "valid_from", F.lead("valid_from").over(after).alias("valid_to"), F.lead("object").over(after).alias("superseded_by"), "asserted")


def strict_fact_intervals(facts: DataFrame) -> DataFrame:
    """As :func:`fact_intervals`, but a fact that was superseded is never active again.

    Each (subject, type, object) is one row from its first assertion. It ends when a new object
    is first asserted afterwards; asserting an ended fact again only counts.
    """
    kept = facts.where(F.lower(F.col("subject").cast("string")) != F.lower(F.col("object").cast("string")))
    first = kept.groupBy("subject", "type", "object").agg(F.min(F.struct("ts", "seq")).alias("_at"), F.count("*").alias("asserted"))
    after = Window.partitionBy("subject", "type").orderBy("_at")
    return first.select("subject", "type", "object", F.col("_at.ts").alias("valid_from"), F.lead("_at.ts").over(after).alias("valid_to"), F.lead("object").over(after).alias("superseded_by"), "asserted")


def active_at(rows: DataFrame, at: Column) -> DataFrame:
    """Rows with valid_from <= at < valid_to; an open end has none."""
    return rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def current_rows(links: DataFrame) -> DataFrame:
    """``id, current, steps``: following ``superseded_by`` forward from every id of ``id, superseded_by``.

    By pointer doubling: each round doubles the steps that a pointer spans, so that a chain of n
    ids takes log2(n) rounds. What then still moves is a cycle or leads into one; its ids have a
    null ``current``.
    """
    hops = as_table(links.select("id", F.coalesce("superseded_by", "id").alias("current"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).cast("long").alias("steps")), "chain")
    for _ in range(hops.count().bit_length() + 1):
        further = hops.select(F.col("id").alias("current"), F.col("current").alias("_next"), F.col("steps").alias("_more"))
        moved = hops.join(further, "current", "left")
        doubled = as_table(moved.select("id", F.coalesce("_next", "current").alias("current"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), "chain")
        still = doubled.agg(F.sum("steps")).first()[0] != hops.agg(F.sum("steps")).first()[0]
        release(hops)
        hops = doubled
        if not still:
            break
    ends = links.where(F.col("superseded_by").isNull()).select(F.col("id").alias("current")).withColumn("_end", F.lit(True))
    return hops.join(ends, "current", "left").select("id", F.when(F.col("_end"), F.col("current")).alias("current"), "steps")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    back = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def reachable(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """``start, node, depth``: breadth-first from each ``start`` up to so many hops, the start at depth 0.

    Only the frontier is joined in each hop; what was visited is taken out by an anti-join. Each
    hop is cut by a table.
    """
    if types is not None:
        edges = edges.where(F.col("type").isin(list(types)))
    steps = _steps(edges, direction)
    visited = frontier = as_table(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, hops + 1):
        met = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = as_table(met.join(visited, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = as_table(visited.unionByName(frontier))
    return visited


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: edges that touch a node; a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def edge_weights(edges: DataFrame, now: int) -> DataFrame:
    """``a, b, w``, a < b: active edges undirected, weights max(0.05, confidence * 0.5^(age/180)) added up, loops dropped."""
    active = edges.where("(valid_to IS NULL OR valid_to = 0) AND (superseded_by IS NULL OR superseded_by = 0) AND from_id <> to_id")
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce("created", F.lit(now))) / F.lit(86400.0))
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    weight = F.greatest(F.lit(EDGE_FLOOR), confidence * F.pow(F.lit(0.5), age / F.lit(EDGE_HALF_LIFE)))
    return active.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.sum(weight).alias("w"))


def personalised_rank(weights: DataFrame, seeds: DataFrame, alpha: float = RESTART, iterations: int = ITERATIONS, small: int = SMALL_GRAPH) -> DataFrame:
    """``query_id, node, rank`` by power iteration from each query's seeds, restarting with ``alpha``.

    ``weights`` comes from :func:`edge_weights`, ``seeds`` has ``query_id, node``. A node passes its
    rank on in proportion to its weights; what a node without edges holds is lost. Rank stays
    with seeds in equal parts. A graph of at most ``small`` nodes is ranked by numpy, per query; a larger
    one by joins, cut every five rounds.
    """
    directed = weights.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(weights.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    out = directed.groupBy("src").agg(F.sum("w").alias("total"))
    moves = as_table(directed.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    seeds = seeds.select("query_id", F.col("node").cast("long").alias("node")).distinct()
    start = seeds.withColumn("rank", 1.0 / F.count("*").over(Window.partitionBy("query_id")))
    n = moves.select("src").distinct().limit(small + 1).count()
    if n <= small:
        return _small_rank(moves, start, alpha, iterations)
    rank = start
    for i in range(iterations):
        moved = rank.join(moves, rank["node"] == moves["src"]).groupBy("query_id", F.col("dst").alias("node")).agg(((1 - alpha) * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        rank = moved.unionByName(start.withColumn("rank", alpha * F.col("rank"))).groupBy("query_id", "node").agg(F.sum("rank").alias("rank"))
        if i % 5 == 4:
            rank = as_table(rank)
    return rank


def _small_rank(moves: DataFrame, start: DataFrame, alpha: float, iterations: int) -> DataFrame:
    edges = moves.toPandas()  # at most SMALL_GRAPH nodes
    nodes = np.unique(np.concatenate([edges["src"], edges["dst"]])) if len(edges) else np.zeros(0, np.int64)
    src, dst, p = np.searchsorted(nodes, edges["src"]), np.searchsorted(nodes, edges["dst"]), edges["p"].to_numpy()

    def one(key, pdf):
        extra = np.setdiff1d(pdf["node"], nodes)
        names = np.concatenate([nodes, extra])
        order = np.argsort(names, kind="stable")
        at = order[np.searchsorted(names[order], pdf["node"].to_numpy())]
        base = np.zeros(len(names))
        np.add.at(base, at, pdf["rank"].to_numpy())
        rank = base.copy()
        for _ in range(iterations):
            moved = np.zeros(len(names))
            np.add.at(moved, dst, rank[src] * p)
            rank = (1 - alpha) * moved + alpha * base
        keep = rank > 0
        import pandas as pd

        return pd.DataFrame({"query_id": key[0], "node": names[keep], "rank": rank[keep]})

    kind = start.schema["query_id"].dataType.simpleString()
    return start.groupBy("query_id").applyInPandas(one, f"query_id {kind}, node long, rank double")


def ranked_files(ranks: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """``query_id, key, score, rank``: files by the sum over the distinct entities they mention, of the 50 best entities above 1e-4."""
    best = top_ranked(ranks.where(F.col("rank") > RANK_LEAST).withColumnRenamed("rank", "weight"), RANK_MOST, ["query_id"], [F.desc(F.round("weight", 12)), F.col("node")])
    pairs = mentions.select(F.col("entity_id").alias("node"), F.col("filename").alias("key")).distinct()
    scored = best.select("query_id", "node", "weight").join(pairs, "node").groupBy("query_id", "key").agg(F.sum("weight").alias("score"))
    return top_ranked(scored, k, ["query_id"], [F.desc(F.round("score", 10)), F.col("key")])


def ranked_files_from(weights: DataFrame, seeds: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """:func:`ranked_files` of the :func:`personalised_rank` from each query's seeds ``query_id, node``; queries with the same seeds are ranked once."""
    sets = as_table(seeds.groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("node").cast("long"))).alias("nodes")), "seeds")
    firsts = as_table(sets.groupBy("nodes").agg(F.min("query_id").alias("first")), "seeds")
    ranks = personalised_rank(weights, firsts.select(F.col("first").alias("query_id"), F.explode("nodes").alias("node")))
    files = as_table(ranked_files(ranks, mentions, k).withColumnRenamed("query_id", "first"), "graph-lane")
    return sets.join(firsts, "nodes").select("query_id", "first").join(files, "first").drop("first")


#: Keys of other letters than a-z: those that hold any, and what their words are cut at.
_OTHER, _OTHER_CUT, _PLAIN_CUT = r"[\p{L}\p{N}&&[^a-z0-9]]", r"[^\p{L}\p{N}]+", "[^a-z0-9]+"


def _words(c: str, cut: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), cut), lambda w: w != "")


def _key_hits(texts: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, and the columns of ``keys`` (``key_low`` among them), of keys that occur in a text as whole words.

    Runs of a text's words, of as many as any key has, are looked up among the keys. Words are of a-z
    and 0-9; keys with other letters or digits have words of any of these, keys without any are
    looked up as they stand between word boundaries.
    """
    found = None
    other = F.col("key_low").rlike(_OTHER)
    for cut, kind in ((_PLAIN_CUT, ~other), (_OTHER_CUT, other)):
        wanted = keys.where(kind).withColumn("_k", _words("key_low", cut)).where("size(_k) > 0")
        sizes = [r["n"] for r in wanted.select(F.size("_k").alias("n")).distinct().collect()]
        if not sizes:
            continue
        wanted = wanted.withColumn("run", F.array_join("_k", " ")).drop("_k").distinct()
        hits = _runs(texts.select(key, _words(text, cut).alias("_w")), [key], sizes, " ").join(sized(wanted), "run").drop("run")
        found = hits if found is None else found.unionByName(hits)
    bare = keys.where(~F.col("key_low").rlike(r"[\p{L}\p{N}]"))
    low = texts.select(key, F.lower(text).alias("_low"))
    hits = _whole_patterns(low, bare.select(F.col("key_low").alias("pattern")), key, "_low").withColumnRenamed("pattern", "key_low").join(bare, "key_low")
    return hits if found is None else found.unionByName(hits)


def mentions_of(docs: DataFrame, keys: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """``key, canonical, excerpt``: entities whose name or alias occurs as whole words in a text.

    ``keys`` has ``key_text, canonical``; keys have three characters and more, of any number of
    words. Each canonical name comes once a text, by its longest key that occurs; the excerpt
    is the first line that holds it. Texts' word runs are looked up among the keys
    (:func:`_key_hits`), so that texts times keys never meet.
    """
    wanted = keys.where(F.length("key_text") >= 3).select(F.lower("key_text").alias("key_low"), "canonical").distinct()
    hits = _key_hits(docs, wanted, key, text)
    best = hits.groupBy(key, "canonical").agg(F.max_by("key_low", F.struct(F.length("key_low"), "key_low")).alias("key_low"))
    return best.join(docs.select(key, F.col(text).alias("_text")), key).select(key, "canonical", first_line_with("_text", F.col("key_low")).alias("excerpt"))


def query_entities(queries: DataFrame, entities: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """``query_id, id``: entities whose name or alias, of three characters and more, occurs as whole words in a query; blocked names never do."""
    keys = entities.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key_text")).where(F.col("key_text").isNotNull())
    keys = keys.where((F.length("key_text") >= 3) & ~F.lower("key_text").isin([b.lower() for b in blocked] or [""]))
    keys = keys.select("id", F.lower("key_text").alias("key_low")).distinct()
    return _key_hits(queries, keys, "query_id", "query").select("query_id", "id").distinct()


def _segments(c: str) -> Column:
    """A text cut at every word boundary: runs of letters, digits and ``_``, and what lies between."""
    return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))


def _whole_patterns(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pattern``: the patterns of ``pattern`` that stand in a text, as they are, between word boundaries.

    Such a pattern is a run of whole segments, so that runs of as many segments are looked up among the patterns.
    """
    wanted = patterns.select("pattern", F.size(_segments("pattern")).alias("n")).where("n > 0").distinct()
    sizes = [r["n"] for r in wanted.select("n").distinct().collect()]
    if not sizes:
        return texts.select(key, F.lit(None).cast("string").alias("pattern")).limit(0)
    cut = texts.select(key, _segments(text).alias("_w"))
    return _runs(cut, [key], sizes, "").join(sized(wanted.select(F.col("pattern").alias("run"))), "run").select(key, F.col("run").alias("pattern")).distinct()


def _runs(df: DataFrame, keep: list[str], sizes: Sequence[int], between: str) -> DataFrame:
    """``keep..., run``: distinct runs of so many parts of ``_w``."""
    parts = ", ".join(f"IF(size(_w) >= {n}, transform(sequence(0, greatest(size(_w) - {n}, 0)), i -> array_join(slice(_w, i + 1, {n}), '{between}')), array())" for n in sorted(sizes))
    return df.select(*keep, F.explode(F.array_distinct(F.expr(f"flatten(array({parts}))"))).alias("run"))


def linked_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """``from_file, to_file``: explicit ``related`` names and file names or stems in ``body``, of files that exist.

    A file name counts wherever it stands in a body, a stem between word boundaries (letters,
    digits and ``_`` make words), both in the same case. Names are looked up by their grams, stems
    among the runs of a body's segments. A file isn't linked with itself.
    """
    known = files.select(F.col(name).alias("to_file"), F.replace(F.col(name), F.lit(".md"), F.lit("")).alias("stem")).distinct()
    said = files.select(F.col(name).alias("from_file"), F.explode(F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda x: F.btrim(x))).alias("to_file"))
    explicit = said.join(known.select("to_file"), "to_file").select("from_file", "to_file")
    bodies = files.select(F.col(name).alias("from_file"), F.col("body").alias("body"))
    named = contained_patterns(bodies, known.select(F.col("to_file").alias("pattern")), "from_file", "body").select("from_file", F.col("pattern").alias("to_file"))
    stems = _whole_patterns(bodies, known.select(F.col("stem").alias("pattern")), "from_file", "body")
    by_stem = stems.join(known.withColumnRenamed("stem", "pattern"), "pattern").select("from_file", "to_file")
    return explicit.unionByName(named).unionByName(by_stem).where("from_file <> to_file").distinct()


def verb_edges(docs: DataFrame, patterns: Sequence[tuple[str, str]], subject: str, key: str = "doc_id", text: str = "body") -> DataFrame:
    """``subject, type, object, confidence, source``: what group 1 of each pattern captures, of 3 to 50 characters."""
    def found(pattern: str, type_: str) -> Column:
        objects = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(objects, lambda x: F.struct(F.lit(type_).alias("type"), F.btrim(x).alias("object")))

    parts = [found(p, t) for p, t in patterns]
    rows = docs.select(F.col(key).alias("source"), F.explode(F.concat(*parts)).alias("e")).select("source", "e.type", "e.object")
    return rows.where(F.length("object").between(3, 50)).select(F.lit(subject).alias("subject"), "type", "object", F.lit(0.6).alias("confidence"), "source").distinct()


def related_edges(files: DataFrame) -> DataFrame:
    """``from_name, to_name, type, source``: ``related`` links between the names of files that exist."""
    links = files.select(F.col("filename").alias("source"), F.col("name").alias("from_name"), F.explode("related").alias("r")).select("source", "from_name", F.btrim("r").alias("filename"))
    return links.join(files.select("filename", F.col("name").alias("to_name")), "filename").select("from_name", "to_name", F.lit("related_to").alias("type"), "source").distinct()


def projected_nodes(edges: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """``node, degree, size, in_focus``: size is 6 + min(20, degree), 6 more in focus."""
    sizes = degrees(edges).withColumn("size", 6 + F.least(F.lit(20), F.col("degree")))
    if focus is None:
        return sizes.withColumn("in_focus", F.lit(False))
    marked = sizes.join(focus.select("node").distinct().withColumn("_f", F.lit(True)), "node", "left").withColumn("in_focus", F.coalesce("_f", F.lit(False))).drop("_f")
    return marked.withColumn("size", F.col("size") + F.when(F.col("in_focus"), 6).otherwise(0))


def typed_edges(layers: dict[str, DataFrame]) -> DataFrame:
    """``type, src, dst`` of several edge queries ``src, dst`` in one, each triple once."""
    out = None
    for name, df in layers.items():
        part = df.select(F.lit(name).alias("type"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, type, n``: entities and edges by type, and in all (type null)."""
    both = entities.select(F.lit("entity").alias("kind"), "type").unionByName(edges.select(F.lit("edge").alias("kind"), "type"))
    return both.rollup("kind", "type").agg(F.count("*").alias("n")).where("kind IS NOT NULL")


def parallel_facts(edges: DataFrame, functional: Sequence[str], before: int) -> DataFrame:
    """``from_id, type, n``: subjects with several active edges of a functional type, created before that time."""
    active = edges.where(F.lower("type").isin([t.lower() for t in functional]) & F.col("valid_to").isNull() & F.col("superseded_by").isNull() & (F.col("created") < before))
    return active.groupBy("from_id", "type").agg(F.count("*").alias("n")).where("n > 1")
