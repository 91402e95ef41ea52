"""Dense retrieval by exact cosine, and pairs of close vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, qualified
from mnemoframe.functions.scores import cosine
from mnemoframe.operators.lexical import sized

#: Query vectors that go to the workers at a time.
QUERIES_PER_BLOCK = 4096
#: Sketches that a task of :func:`close_pairs` holds, and pairs of them that are compared at a time.
SKETCHES_PER_TASK, PAIRS_PER_BLOCK = 1_000_000, 200_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _block_scores(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[list, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Each batch's k best rows of the length of a query, for the queries by length."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy()
        for n, (names, unit) in asked.items():
            at = np.flatnonzero(lengths == n)
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            rows = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n))
            scores = rows @ unit.T * part.column(2).to_numpy()[:, None]
            # Rows tied with the last stay too; the ranking over all batches decides.
            last = -np.partition(-scores, min(k, len(at)) - 1, axis=0)[min(k, len(at)) - 1]
            row, query = np.nonzero(scores >= last)
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], pa.int64()), part.column(0).take(pa.array(row)), pa.array(scores[row, query])], names=["query_id", "key", "score"])


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, factor: str | None = None, least: float | None = None) -> DataFrame:
    """``query_id, key, score, rank``: the k rows of the greatest cosine for each query, exactly.

    ``vectors`` has ``key bigint, vector`` and a column ``factor`` that multiplies the score if
    named; ``queries`` has ``query_id bigint, vector``. A query is held against the rows whose vector is as
    long as its own. Rows and queries without vector are left out; a zero vector scores 0. Ties go by key.

    The queries are a stated set: they go out in blocks of bounded size, and every row is held
    against a block by one matrix product. Only the k best of each batch are shuffled.
    """
    out_schema = "query_id bigint, key bigint, score double"
    asked = queries.where("size(vector) > 0").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    rows = vectors.where("size(vector) > 0").select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"), (F.col(factor).cast("double") if factor else F.lit(1.0)).alias("factor"))
    found = vectors.sparkSession.createDataFrame([], out_schema)

    def scored(block):
        by_length: dict[int, list] = {}
        for q, v in block:
            by_length.setdefault(len(v), []).append((q, v))
        shared = vectors.sparkSession.sparkContext.broadcast({n: ([q for q, _ in own], _unit(np.array([v for _, v in own]))) for n, own in by_length.items()})
        return rows.mapInArrow(lambda it: _block_scores(it, shared.value, k), out_schema)

    block: list = []
    for r in asked.toLocalIterator():
        block.append((r["query_id"], r["vector"]))
        if len(block) == QUERIES_PER_BLOCK:
            found, block = found.unionByName(scored(block)), []
    if block:
        found = found.unionByName(scored(block))
    if least is not None:
        found = found.where(F.round("score", 10) >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sketched(batches: Iterator[pa.RecordBatch], bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``key, digest, size, sketch``: equal vectors have equal digests; the sketch has a bit for each hyperplane, a zero vector has none."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths).astype(int).tolist():
            part = batch.take(pa.array(np.flatnonzero(lengths == n)))
            matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, n) + 0.0  # of two zeros only one stays
            digests = [hashlib.blake2b(row, digest_size=16).digest() for row in matrix]
            sketches = np.packbits(_unit(matrix) @ np.random.default_rng(seed).standard_normal((n, bits)) > 0, axis=1)
            alive = np.abs(matrix).sum(axis=1) > 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), pa.array(np.full(part.num_rows, n, np.int32)), pa.array([x.tobytes() if on else None for x, on in zip(sketches, alive)], pa.binary())], names=["key", "digest", "size", "sketch"]
            )


def _buckets(sketches: np.ndarray, table: int, planes: int) -> np.ndarray:
    lo, hi = table * planes // 8, -(-(table + 1) * planes // 8)
    bits = np.unpackbits(sketches[:, lo:hi], axis=1)[:, table * planes - 8 * lo :][:, :planes]
    return bits @ (1 << np.arange(planes, dtype=np.int64))


def _met(turns: Iterator[pa.RecordBatch], path: str, most: int, planes: int, parts: int) -> Iterator[pa.RecordBatch]:
    """``a, b``: of one table and part of its buckets, the pairs of a bucket whose sketches differ in ``most`` bits at most.

    A pair comes out of the first table in which it meets.
    """
    store, root = pa.fs.FileSystem.from_uri(path)
    files = sorted(x.path for x in store.get_file_info(pa.fs.FileSelector(root)) if x.path.endswith(".parquet"))
    for turn in (n for batch in turns for n in batch.column(0).to_pylist()):
        table, own = divmod(turn, parts)
        names, sizes, sketches, buckets = [], [], [], []
        for file in files:
            with store.open_input_file(file) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["key", "size", "sketch"]):
                    if not batch.num_rows:
                        continue
                    sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    bucket = _buckets(sketch, table, planes)
                    at = np.flatnonzero(bucket * parts >> planes == own)
                    names.append(batch.column(0).take(pa.array(at)))
                    sizes.append(batch.column(1).to_numpy()[at]), sketches.append(sketch[at]), buckets.append(bucket[at])
        if not names:
            continue
        group = np.concatenate(buckets) + (np.concatenate(sizes).astype(np.int64) << planes)
        order = np.argsort(group, kind="stable")
        group, sketch, keys = group[order], np.concatenate(sketches)[order], pa.chunked_array(names).take(pa.array(order)).combine_chunks()
        wide = np.zeros((len(sketch), -(-sketch.shape[1] // 8) * 8), np.uint8)
        wide[:, : sketch.shape[1]] = sketch
        words, at, step = wide.view(np.uint64), np.arange(len(group)), 0
        while len(at):
            step += 1
            at = at[at + step < len(group)]
            at = at[group[at + step] == group[at]]
            for lo in range(0, len(at), PAIRS_PER_BLOCK):
                x = at[lo : lo + PAIRS_PER_BLOCK]
                x = x[np.bitwise_count(words[x] ^ words[x + step]).sum(axis=1) <= most]
                for before in range(table):
                    if not len(x):
                        break
                    x = x[_buckets(sketch[x], before, planes) != _buckets(sketch[x + step], before, planes)]
                if len(x):
                    one, two = keys.take(pa.array(x)), keys.take(pa.array(x + step))
                    less = pc.less(one, two)
                    yield pa.RecordBatch.from_arrays([pc.if_else(less, one, two), pc.if_else(less, two, one)], names=["a", "b"])


def close_pairs(vectors: DataFrame, least: float, planes: int = 16, tables: int = 64, seed: int = 11, copies: bool = False) -> DataFrame:
    """``a, b, similarity`` of classes of equal vectors with at least that cosine, a < b by smallest key.

    ``vectors`` has ``key, vector``. Random hyperplanes hash vectors into
    buckets of ``tables`` tables; what shares a bucket is compared. A pair at angle t
    meets with probability 1 - (1 - (1 - t/pi)^planes)^tables: 0.9995 at a cosine of 0.92, nearly one above. Pairs
    below ``least`` never come out. Zero vectors are similar to none. ``copies`` adds each vector's pair with the first of its class.

    The bits of all hyperplanes are a vector's sketch. A task has a table's buckets, reads the sketches itself and compares those of a bucket;
    only pairs whose sketches differ in no more bits than a pair at ``least`` would, and seven deviations, meet as vectors. No row per vector and table, and
    no row per pair of a bucket, is shuffled.
    """
    spark, bits = vectors.sparkSession, planes * tables
    kept = as_table(vectors.select("key", "vector").where("vector IS NOT NULL"), "vectors", freed=True)
    kind = kept.schema["key"].dataType.simpleString()
    described = as_table(kept.mapInArrow(lambda it: _sketched(it, bits, seed), f"key {kind}, digest binary, size int, sketch binary"), "sketched")
    firsts = described.groupBy("digest").agg(F.min("key").alias("first"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    classes = as_table(firsts.where("first IS NOT NULL AND sketch IS NOT NULL").select(F.col("first").alias("key"), "size", "sketch"), "sketches", freed=True)
    p = math.acos(least) / math.pi
    most = math.floor(bits * p + 7 * math.sqrt(bits * p * (1 - p))) + 1
    parts = max(1, -(-classes.count() // SKETCHES_PER_TASK))
    path = qualified(spark, classes._mnemoframe_path)
    met = as_table(spark.range(0, tables * parts, 1, tables * parts).mapInArrow(lambda it: _met(it, path, most, planes, parts), f"a {kind}, b {kind}"), "met")
    vector = F.col("vector").cast("array<double>")
    both = kept.select(F.col("key").alias("a"), vector.alias("va")).join(sized(met), "a").join(kept.select(F.col("key").alias("b"), vector.alias("vb")), "b")
    pairs = both.select("a", "b", cosine("va", "vb").alias("similarity")).where(F.round("similarity", 10) >= least)
    if not copies:
        return pairs
    again = described.select("key", "digest").join(described.groupBy("digest").agg(F.min("key").alias("first")), "digest").where("key <> first")
    return pairs.unionByName(again.select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity")))
