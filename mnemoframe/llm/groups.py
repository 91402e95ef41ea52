"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release


def _ordered_ids(names: DataFrame) -> DataFrame:
    """``name, id`` with ids in the names' alphabetical order, kept in a table so that they stay."""
    ranged = names.repartitionByRange("name").sortWithinPartitions("name")
    return as_table(ranged.withColumn("id", F.monotonically_increasing_id()), "group-ids")


def _flattened(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every ``node`` gets the root of its tree as ``parent``.

    A parent that isn't a node itself is a root. Each round halves the depth and is written to the shared folder.
    """
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = as_table(parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "group-jump")
        done = jumped.where("moved").isEmpty()
        release(parents)
        parents = jumped
        if done:
            return parents


def connected_groups(links: DataFrame, a: Column | str = "a", b: Column | str = "b") -> DataFrame:
    """``group, member``: a row for each record that is linked, directly or not, with another.

    ``group`` is the alphabetically first member of the group. Links with a null end or from a
    record to itself don't count; direction and repeats play no role. No links give no rows.

    Every round gives each root the smallest label among its neighbours (propagation), flattens
    the trees that arise by pointer jumping, and draws the links between the roots that remain.
    It ends when no link joins two roots, that is when no label changes. Each round's links and
    labels are written to the shared folder, which ends their lineage; the
    round before is deleted. A record with very many links
    is only ever pre-aggregated or on the split side of a join.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    named = links.select(a.cast("string").alias("a"), b.cast("string").alias("b")).where("a <> b")
    named = as_table(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "group-links")
    ids = _ordered_ids(named.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    edges = (
        named.join(ids.select(F.col("name").alias("a"), F.col("id").alias("low")), "a")
        .join(ids.select(F.col("name").alias("b"), F.col("id").alias("high")), "b")
        .select("low", "high")
    )
    edges = as_table(edges, "group-edges")
    labels = as_table(ids.select("name", F.col("id").alias("label")), "group-labels")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))
        roots = _flattened(as_table(hooks, "group-hooks")).select("node", "parent")
        drawn = edges
        for end in ("low", "high"):
            drawn = drawn.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        drawn = as_table(drawn.where("low <> high").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "group-edges")
        moved = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
        renamed = as_table(moved.select("name", F.coalesce("parent", "label").alias("label")), "group-labels")
        release(edges, labels)
        edges, labels = drawn, renamed
    firsts = ids.select(F.col("id").alias("label"), F.col("name").alias("group"))
    return labels.join(firsts, "label").select("group", F.col("name").alias("member"))
