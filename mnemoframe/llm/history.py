"""Deduplicating new batches against all history."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, deleted, entries_of, qualified, release, shared_folder

#: Sorted signature permutations of the forest, and the bits that name one in a key.
TREES, TREE_BITS = 48, 6
#: Levels of a tree; a level is so many bits of one minimum hash. Tree and path together are one positive long.
LEVELS, LEVEL_BITS = 9, 6
#: Share of the pairs at the similarity limit itself that the forest has to find; above it more are found.
RECALL = 0.995
#: Bits of the sketch that is compared before texts are.
SKETCH_BITS = 256
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Records whose hashes a worker computes at a time.
ROWS_PER_PASS = 256
#: Keys aimed at in a bucket of a run, keys of a batch that are located at a time, and pairs that are compared at a time.
KEYS_PER_BUCKET, KEYS_PER_PASS, PAIRS_PER_PASS = 1_000_000, 100_000, 1_000_000
#: Runs of about one size that are merged into one; sizes are about one if they have the same power of this.
FANOUT = 8
#: Bytes of a run's row groups, which a search reads or skips as a whole.
ROW_GROUP_BYTES = 4 << 20


def recall_at(depth: int, similarity: float, trees: int = TREES) -> float:
    """The share of pairs of that similarity that agree on a prefix of ``depth`` levels in some tree."""
    level = similarity + (1 - similarity) / (1 << LEVEL_BITS)
    return 1 - (1 - level**depth) ** trees


def depths_for(similarity: float, recall: float = RECALL) -> list[int]:
    """The prefix lengths of a search: the whole path, then shorter ones, level by level, until the recall is reached."""
    depths = [LEVELS]
    while recall_at(depths[-1], similarity) < recall and depths[-1] > 1:
        depths.append(depths[-1] - 1)
    return depths


def sketch_limit(similarity: float) -> int:
    """Bits that sketches of a pair at the limit may differ in: the mean and four deviations."""
    p = (1 - similarity) / 2
    return int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5) + 1


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    n = TREES * LEVELS + SKETCH_BITS
    return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each record (class, hashes of its words) a row for each tree: key, class and sketch."""
    factor, offset = _functions()
    shift = np.uint64(LEVEL_BITS) * np.arange(LEVELS - 1, -1, -1, dtype=np.uint64)
    tree = np.arange(TREES, dtype=np.uint64) << np.uint64(LEVELS * LEVEL_BITS)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy().astype(np.int64)
        words = batch.column(1).flatten().to_numpy().view(np.uint64)
        classes = batch.column(0).to_numpy()
        ends = ends - ends[0]
        for lo in range(0, batch.num_rows, ROWS_PER_PASS):
            hi = min(lo + ROWS_PER_PASS, batch.num_rows)
            own = words[ends[lo] : ends[hi]]
            least = _mixed(np.minimum.reduceat(own[:, None] * factor + offset, ends[lo:hi] - ends[lo], axis=0))
            levels = (least[:, : TREES * LEVELS] & np.uint64((1 << LEVEL_BITS) - 1)).reshape(-1, TREES, LEVELS)
            keys = (levels << shift).sum(axis=2, dtype=np.uint64) + tree
            bits = (least[:, TREES * LEVELS :] & np.uint64(1)).reshape(-1, len(_SKETCH), 64)
            sketch = (bits * bit).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(classes[lo:hi], TREES))] + [pa.array(np.repeat(sketch[:, i], TREES)) for i in range(len(_SKETCH))],
                names=["key", "class", *_SKETCH],
            )


_SIGNED = "key bigint, class bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH)


def words_of(*texts: Column | str) -> Column:
    """The sorted set of words of the texts together, null as empty: runs of a-z, 0-9 and ``_``."""
    whole = F.lower(F.concat_ws(" ", *texts))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit("([a-z0-9_]+)"), F.lit(1))))


@dataclass(frozen=True)
class Run:
    """A sorted run of the forest: a folder with a subfolder for each value of the keys' first bits."""

    path: str
    keys: int
    bits: int

    @property
    def shift(self) -> int:
        return TREE_BITS + LEVELS * LEVEL_BITS - self.bits


def _located(q: np.ndarray, k: np.ndarray, depths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``q`` and in ``k``, both sorted, of keys that share a prefix of the last of ``depths`` levels.

    Each key's range in ``k`` is found by binary search for the longest prefix. It is then
    widened on both sides from one prefix length to the next, and what came new is handed out.
    """
    upper = lower = None
    for depth in depths:
        free = LEVEL_BITS * (LEVELS - depth)
        start = q >> free << free
        lo, hi = np.searchsorted(k, start), np.searchsorted(k, start + (1 << free))
        for a, b in ((lo, hi),) if lower is None else ((lo, lower), (upper, hi)):
            sizes = b - a
            some = np.flatnonzero(sizes)
            upto = np.cumsum(sizes[some])
            at = 0
            while at < len(some):
                # As many ranges as have PAIRS_PER_PASS pairs together; a longer one comes alone.
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_PER_PASS, side="right")))
                part = some[at:end]
                of = np.repeat(part, sizes[part])
                yield of, np.arange(len(of)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]) + np.repeat(a[part], sizes[part])
                at = end
        lower, upper = lo, hi


def _groups_within(run: Run, first: int, last: int) -> Iterator[pa.Table]:
    """The row groups of a run that may hold keys from ``first`` to ``last``; others aren't read."""
    store, root = pa.fs.FileSystem.from_uri(run.path)
    for bucket in range(first >> run.shift, (last >> run.shift) + 1):
        for info in store.get_file_info(pa.fs.FileSelector(f"{root}/bucket={bucket}", allow_not_found=True)):
            if not info.base_name.endswith(".parquet"):
                continue
            with store.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                at = file.schema_arrow.get_field_index("key")
                for g in range(file.num_row_groups):
                    bounds = file.metadata.row_group(g).column(at).statistics
                    if bounds is None or not bounds.has_min_max or (bounds.min <= last and bounds.max >= first):
                        yield file.read_row_group(g, columns=["key", "class", *_SKETCH])


def _search(batches: Iterator[pa.RecordBatch], runs: list[Run], depths: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """``class, other`` (class < other) of a batch's keys, which come sorted file by file, and the runs' that are near."""
    columns = lambda t: (t.column("class").to_numpy(), [t.column(s).to_numpy().view(np.uint64) for s in _SKETCH])  # noqa: E731; counts of bits are of absolute values
    widest = LEVEL_BITS * (LEVELS - depths[-1])
    for batch in batches:
        order = np.argsort(batch.column("key").to_numpy(), kind="stable")
        for at in range(0, len(order), KEYS_PER_PASS):
            part = batch.take(pa.array(order[at : at + KEYS_PER_PASS]))
            keys, (own, mine) = part.column("key").to_numpy(), columns(part)
            first, last = int(keys[0]) >> widest << widest, (int(keys[-1]) >> widest << widest) + (1 << widest) - 1
            for run in runs:
                for group in _groups_within(run, first, last):
                    there, (names, theirs) = group.column("key").to_numpy(), columns(group)
                    for i, j in _located(keys, there, depths):
                        differ = sum(np.bitwise_count(a[i] ^ b[j]).astype(np.int16) for a, b in zip(mine, theirs))
                        a, b = own[i], names[j]
                        near = (differ <= most) & (a != b)
                        if near.any():
                            a, b = a[near], b[near]
                            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["class", "other"])


class HashForest:
    """A prefix-tree hash forest over word sets, kept as sorted runs in a named folder.

    A key is a tree's number and a path: the minimum hashes of the record's words under that
    tree's functions, a level each. A run holds the keys of some records in order, cut by their
    first bits into buckets, so that keys with a common prefix lie next to each other. Each
    batch adds a run; runs of about one size are merged. What is there is found again by
    opening a forest of the same name; a run's size stands in its folder's name.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None) -> None:
        self.spark = spark
        self.root = qualified(spark, f"{folder or shared_folder(spark)}/forest-{name}")

    def runs(self) -> list[Run]:
        """The finished runs, oldest first."""
        found = []
        for name in entries_of(self.spark, self.root):
            if name.startswith("run-") and "_SUCCESS" in entries_of(self.spark, f"{self.root}/{name}"):
                _, _, keys, bits = name.split("-")
                found.append(Run(f"{self.root}/{name}", int(keys), int(bits)))
        return sorted(found, key=lambda r: r.path.rsplit("/", 1)[-1].split("-")[1])

    def _written(self, signed: DataFrame, keys: int) -> Run:
        last = max([0, *(int(r.path.rsplit("/", 1)[-1].split("-")[1]) for r in self.runs())])
        bits = max(3, TREE_BITS + (-(-keys // (TREES * KEYS_PER_BUCKET)) - 1).bit_length())
        bits = 3 if keys <= TREES * KEYS_PER_BUCKET // 8 else bits
        run = Run(f"{self.root}/run-{last + 1:08d}-{keys}-{bits}", keys, bits)
        bucketed = signed.withColumn("bucket", F.shiftright("key", run.shift))
        # A rebalanced shuffle splits a bucket that is too large; each of its files is sorted.
        placed = bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
        placed.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP_BYTES).parquet(run.path)
        return run

    def append(self, classes: DataFrame, rows: int) -> Run:
        """Adds a run for these records, ``class bigint, words array<string>``, so many; empty sets have no keys. Only they are signed."""
        hashes = classes.where(F.size("words") > 0).select("class", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        return self._written(hashes.mapInArrow(_signatures, _SIGNED), rows * TREES)

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(f"{_SIGNED}, bucket bigint").parquet(run.path)

    def merge(self) -> None:
        """Makes runs of about one size one, where FANOUT of them have come together, until there are no such."""
        while True:
            tiers: dict[int, list[Run]] = {}
            for run in self.runs():
                tiers.setdefault(len(np.base_repr(max(1, run.keys), FANOUT)), []).append(run)
            full = next((own for own in tiers.values() if len(own) >= FANOUT), None)
            if full is None:
                return
            self.merged(full)

    def merged(self, runs: list[Run]) -> Run:
        """One run of the keys of several, which are then deleted."""
        whole = self._read(runs[0])
        for run in runs[1:]:
            whole = whole.unionByName(self._read(run))
        run = self._written(whole.drop("bucket"), sum(r.keys for r in runs))
        deleted(self.spark, *[r.path for r in runs])
        return run

    def candidates(self, batch: Run, similarity: float) -> DataFrame:
        """``class, other`` (class < other): records of a batch's run and records of any run, its own too, that may be similar.

        The batch's keys are located in the sorted runs by range search, with prefixes that are
        shortened level by level until :func:`recall_at` reaches RECALL, and pairs whose sketches
        differ in too many bits are left out. Runs aren't shuffled: a batch's tasks read those of
        their row groups in which their keys can lie, one at a time. A pair may come more than once.
        """
        runs, depths, most = self.runs(), depths_for(similarity), sketch_limit(similarity)
        return self._read(batch).drop("bucket").mapInArrow(lambda it: _search(it, runs, depths, most), "class bigint, other bigint")

    def drop(self) -> None:
        deleted(self.spark, self.root)


def _verified(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``class, other`` whose words share that much; words are compared themselves."""
    words = classes.select("class", "words")
    both = pairs.join(words, "class").join(words.withColumnsRenamed({"class": "other", "words": "other_words"}), "other")
    common = F.size(F.array_intersect("words", "other_words"))
    share = common / (F.size("words") + F.size("other_words") - common)
    return both.where(share >= similarity).select("class", "other")


def near_duplicates_of_history(rows: DataFrame, id: str, batch: str, words: Column, similarity: float = 0.7) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): ids of different batches whose word sets are that similar.

    Similar are sets that share at least ``similarity`` of their union; empty sets are similar
    to none. Rows with a null id or batch don't count, repeated rows are one.

    The batches are fed to a :class:`HashForest` in their order. Of each only the word sets that no batch
    before had are signed and appended as a run; these are located in the runs so far, and runs
    are merged as they add up. Equal word sets are one class; classes are searched, verified word
    by word, and only then are the members of both sides put together where their batches differ.
    The forest finds a pair at the limit with probability RECALL, pairs above it more surely; the
    verification lets no false pair through.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(batch).cast("long").alias("batch"), words.alias("words")).where("id IS NOT NULL AND batch IS NOT NULL AND size(words) > 0")
    found = rows.groupBy("words").agg(F.min("batch").alias("batch")).withColumn("class", F.monotonically_increasing_id())
    classes = as_table(found.select("class", "words", "batch"), "word-classes")
    members = as_table(rows.join(classes.select("class", "words"), "words").select("class", "id", "batch").distinct(), "word-members")
    sizes = {r["batch"]: r["count"] for r in classes.groupBy("batch").count().toLocalIterator()}
    forest = HashForest(spark, uuid.uuid4().hex)
    met = f"{forest.root}/met"
    for b in sorted(sizes):
        run = forest.append(classes.where(F.col("batch") == b), sizes[b])
        forest.candidates(run, similarity).write.mode("append").parquet(met)
        forest.merge()
    pairs = spark.read.schema("class bigint, other bigint").parquet(met) if sizes else spark.createDataFrame([], "class bigint, other bigint")
    similar = as_table(_verified(pairs.distinct(), classes, similarity), "forest-similar")
    forest.drop()
    release(classes)
    repeated = members.groupBy("class").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).where("lo < hi").select("class", F.col("class").alias("other"))
    a = members.withColumnsRenamed({"id": "a", "batch": "batch_a"})
    b = members.withColumnsRenamed({"class": "other", "id": "b", "batch": "batch_b"})
    paired = similar.unionByName(repeated).join(a, "class").join(b, "other").where("batch_a <> batch_b AND a <> b")
    return paired.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def repeated_records(rows: DataFrame, id: str, batch: str, key: Column, fallback: Column) -> DataFrame:
    """``id_a, id_b``: the smallest id of a record and each id of it in a later batch.

    A record is what has the same ``key``; a row without key is the record whose ``fallback`` it
    shares, of the smallest key if there are several, else a record of its own fallback. Rows with a null id
    or batch, or with neither key nor fallback, don't count. Repeated rows are one.
    """
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(batch).cast("long").alias("batch"), key.alias("key"), fallback.alias("fallback"))
    rows = rows.where("id IS NOT NULL AND batch IS NOT NULL")
    known = rows.where("key IS NOT NULL AND fallback IS NOT NULL").groupBy("fallback").agg(F.min("key").alias("known"))
    keyless = rows.where("key IS NULL AND fallback IS NOT NULL").join(known, "fallback", "left")
    keyless = keyless.select("id", "batch", F.coalesce(F.concat(F.lit("k"), "known"), F.concat(F.lit("f"), "fallback")).alias("record"))
    keyed = rows.where("key IS NOT NULL").select("id", "batch", F.concat(F.lit("k"), "key").alias("record"))
    records = keyed.unionByName(keyless)
    first = records.groupBy("record").agg(F.min(F.struct("id", "batch")).alias("first"), F.max("batch").alias("last")).where("last > first.batch")
    later = records.join(first, "record").where("batch > first.batch AND id > first.id")
    return later.select(F.col("first.id").alias("id_a"), F.col("id").alias("id_b")).distinct()
