"""Items that appear together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release

#: Most items of a basket that are one record of a block; larger baskets are split by item.
BLOCK_ITEMS = 1024
#: Products that are summed at a time; bounds a worker's memory.
PRODUCTS_PER_PASS = 2_000_000
#: Items, of eight bytes each, up to which the list of those that are frequent enough goes to the workers.
BROADCAST_CODES = 500_000
#: Cells of a block's product up to which they are summed in a dense matrix.
DENSE_CELLS = 4_000_000


class BinaryBlock:
    """A sparse binary matrix, records by items: the items of each record, one record after the other.

    ``names`` are the items in order, ``columns`` their places for each entry, sorted within a record.
    """

    def __init__(self, items: np.ndarray, sizes: np.ndarray) -> None:
        self.names, columns = np.unique(items, return_inverse=True)
        self.ends = np.cumsum(sizes)
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.columns = columns[np.lexsort((columns, self.rows))]

    def transposed(self) -> tuple[np.ndarray, np.ndarray]:
        """The transpose's entries in its order: item, and the entry's place in this block."""
        place = np.argsort(self.columns, kind="stable")
        return self.columns[place], place

    def gram(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The transpose times the block, above the diagonal, as (item, item, records).

        Row i of the product is the sum of the records that hold item i; of each only the items
        after i are added, as the product is symmetric.
        """
        item, place = self.transposed()
        after = self.ends[self.rows[place]] - place - 1
        cells = _summed(np.repeat(item, after), self.columns[_ranges(place + 1, after)], len(self.names), len(self.names))
        return self.names[cells[0]], self.names[cells[1]], cells[2]

    def times(self, other: BinaryBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The transpose times another block of the same records, which has other items."""
        item, place = self.transposed()
        row = self.rows[place]
        sizes = np.diff(other.ends, prepend=0)
        cells = _summed(np.repeat(item, sizes[row]), other.columns[_ranges(other.ends[row] - sizes[row], sizes[row])], len(self.names), len(other.names))
        return self.names[cells[0]], other.names[cells[1]], cells[2]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _summed(i: np.ndarray, j: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a matrix of ones at (i, j) that aren't zero, with their sums."""
    cells = i.astype(np.int64) * width + j
    if height * width <= DENSE_CELLS:
        counts = np.bincount(cells, minlength=1)
        cells = np.flatnonzero(counts)
        counts = counts[cells]
    else:
        cells, counts = np.unique(cells, return_counts=True)
    return cells // max(1, width), cells % max(1, width), counts


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy().astype(np.int64))


def _passes(products: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of records with at most PRODUCTS_PER_PASS products together; a larger record is one alone."""
    upto, lo = np.cumsum(products), 0
    while lo < len(products):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS_PER_PASS, side="right")))
        yield lo, hi
        lo = hi


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the records of column 0 with themselves or, where column 1 isn't null, with those of column 1."""
    for batch in batches:
        alone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for own in (alone, ~alone):
            part = batch.take(pa.array(np.flatnonzero(own)))
            if not part.num_rows:
                continue
            items, sizes = _flat(part.column(0))
            others, more = _flat(part.column(1)) if own is not alone else (None, None)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in _passes(sizes * (sizes if more is None else more)):
                block = BinaryBlock(items[begin[lo] : begin[hi]], sizes[lo:hi])
                if more is None:
                    yield _batch(*block.gram())
                else:
                    at = np.concatenate([[0], np.cumsum(more)])
                    yield _batch(*block.times(BinaryBlock(others[at[lo] : at[hi]], more[lo:hi])))


def _coded(entries: DataFrame) -> tuple[DataFrame, Column]:
    """``code, item, n`` of the entries' items, and the expression that codes an item, under which all codes differ."""
    for seed in range(42, 50):
        code = F.xxhash64("item", F.lit(seed))
        items = as_table(entries.groupBy(code.alias("code")).agg(F.min("item").alias("item"), F.max("item").alias("last"), F.count("*").alias("n")), "together-items")
        if items.where("item <> last").isEmpty():
            return items.select("code", "item", "n"), code
    raise RuntimeError("no seed gives every item a code of its own")


def items_together(rows: DataFrame, basket: list[str], item: str, least_together: int = 5, least_ratio: float = 3.0) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n_baskets, ratio`` of the pairs that pass both limits.

    A basket is the set of distinct items of the rows that are equal in the basket columns.
    ``n_ab`` counts the baskets with both items; ``ratio`` is n_ab * n_baskets / (n_a * n_b), how
    much more often than chance. item_a < item_b. A row with a null item or basket column
    doesn't count; a basket of one item counts in ``n_baskets``. No rows give no pairs.

    Blocked Gram matrix: items become integers, baskets records of sparse binary blocks. Each
    worker multiplies the transpose of a block of records with the block, and the products are
    added up by cell. Items in fewer baskets than ``least_together`` can't be in a pair and are
    left out of the blocks, all others are in, however frequent. A basket of many items is split by item into parts;
    each two of its parts meet under a key of their own and are multiplied as two blocks, so that
    such a basket never is in one place.

    The rows are read once: distinct entries of basket (a hash of 128 bits) and item are written, and all
    counts are taken from these.
    """
    keyed = rows.where(F.col(item).isNotNull())
    for c in basket:
        keyed = keyed.where(F.col(c).isNotNull())
    entries = keyed.select(F.xxhash64(F.lit(1), *basket).alias("b1"), F.xxhash64(*basket, F.lit(2)).alias("b2"), F.col(item).cast("string").alias("item")).distinct()
    entries = as_table(entries, "together-entries")
    items, code = _coded(entries)
    frequent = as_table(items.where(F.col("n") >= least_together), "together-frequent")
    known = frequent.select("code")
    known = F.broadcast(known) if known.count() <= BROADCAST_CODES else known
    coded = entries.select("b1", "b2", code.alias("code")).join(known, "code", "left_semi")
    sizes = entries.groupBy("b1", "b2").agg(F.count("*").alias("k"))
    n_baskets, n_large = sizes.agg(F.count("*"), F.count_if(F.col("k") > BLOCK_ITEMS)).first()
    empty = F.lit(None).cast("array<bigint>")
    if not n_large:
        blocks = coded.groupBy("b1", "b2").agg(F.collect_list("code").alias("left"), F.count("*").alias("k")).where("k > 1").select("left", empty.alias("right"))
    else:
        large = as_table(sizes.where(F.col("k") > BLOCK_ITEMS).select("b1", "b2", F.ceil(F.col("k") / F.lit(BLOCK_ITEMS // 2)).cast("int").alias("parts")), "together-large")
        small = coded.join(large, ["b1", "b2"], "left_anti").groupBy("b1", "b2").agg(F.collect_list("code").alias("left"), F.count("*").alias("k")).where("k > 1")
        split = coded.join(large, ["b1", "b2"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
        split = as_table(split.groupBy("b1", "b2", "part").agg(F.collect_list("code").alias("codes"), F.first("parts").alias("parts")), "together-parts")
        sent = split.select("b1", "b2", "part", "codes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
        met = sent.groupBy("b1", "b2", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q")).agg(
            F.max(F.when(F.col("part") <= F.col("with"), F.col("codes"))).alias("left"), F.max(F.when(F.col("part") > F.col("with"), F.col("codes"))).alias("right")
        )
        blocks = small.select("left", empty.alias("right")).unionByName(met.where("left IS NOT NULL AND (p = q OR right IS NOT NULL)").select("left", "right"))
    gram = blocks.mapInArrow(_multiplied, "a bigint, b bigint, n bigint")
    pairs = as_table(gram.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least_together), "together-pairs")
    release(entries)
    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(frequent.select(F.col("code").alias(side), F.col("item").alias(f"name_{side}"), F.col("n").alias(f"count_{side}")), side)
    in_order = F.col("name_a") < F.col("name_b")
    pick = lambda x, y, out: F.when(in_order, F.col(x)).otherwise(F.col(y)).alias(out)
    return joined.where(
        F.col("n_ab").cast("double") * n_baskets >= F.lit(float(least_ratio)) * F.col("count_a") * F.col("count_b")
    ).select(
        pick("name_a", "name_b", "item_a"), pick("name_b", "name_a", "item_b"), "n_ab", pick("count_a", "count_b", "n_a"), pick("count_b", "count_a", "n_b"),
        F.lit(n_baskets).cast("bigint").alias("n_baskets"),
        (F.col("n_ab").cast("double") * n_baskets / (F.col("count_a").cast("double") * F.col("count_b"))).alias("ratio"),
    )
