"""Most similar vectors for every vector."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, entries_of, qualified, release

#: Vectors on which a model's codebooks are fitted, at most about so many, or so many a centroid if that is more.
TRAINING_ROWS, ROWS_PER_CENTROID = 20_000, 32
#: Vectors aimed at per pair of centroids, and most centroids of a half.
ROWS_PER_CELL, CENTROIDS = 1, 2048
#: A query's traversal ends when it has reached this many times the root of the model's rows, and at least LEAST_CANDIDATES.
CANDIDATES_PER_ROOT, LEAST_CANDIDATES = 4.0, 1000
#: Models with fewer vectors, or with a smaller share of all, have one cell: all of their vectors are compared.
LEAST_ROWS, LEAST_SHARE = 1000, 1e-4
#: Entries of a shard, at most about so many and, where that is less, a SHARDS-th of all or LEAST_PER_SHARD.
ROWS_PER_SHARD, SHARDS, LEAST_PER_SHARD = 16_384, 24, 1000
#: Cells with entries up to which their order is found for so many queries at once.
SORTED_CELLS, QUERIES_PER_PASS = 2048, 256
#: Bytes of vectors that are laid out in shards in one pass: so many times those of all vectors, and at least PASS_BYTES.
PASS_SHARE, PASS_BYTES = 3.0, 64 << 20
#: A cell of so many entries is multiplied with its queries if it has so many pairs with them; others go pair by pair, so many at a time.
ROWS_PER_PRODUCT, PAIRS_PER_PRODUCT, PAIRS_AT_ONCE = 4, 1024, 1024
#: Scores that a task holds at a time, and the candidates of the queries whose visits are found at a time.
SCORES, VISITS = 1 << 20, 1 << 25


def usable_vector(vector: Column | str, dim: Column | str) -> Column:
    """Whether a vector has its length, only finite numbers, and one that isn't zero."""
    vector, dim = (F.col(c) if isinstance(c, str) else c for c in (vector, dim))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of equal length of a column as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    matrix = matrix / largest  # squares of huge or tiny numbers would leave the range
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)


def _k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    draw = np.random.default_rng(7)
    k = min(k, len(points))
    centroids = points[np.sort(draw.choice(len(points), k, replace=False))].copy()
    for _ in range(rounds):
        of = _distances(points, centroids).argmin(1)
        sums, counts = np.zeros_like(centroids), np.bincount(of, minlength=k)
        np.add.at(sums, of, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass
class MultiIndex:
    """An inverted multi-index of one model: a codebook for each half, the cells' sizes, and into how many parts large cells are laid."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray | None = None
    full: np.ndarray | None = None
    parts: dict[int, int] | None = None

    @classmethod
    def fitted(cls, vectors: np.ndarray, rows: int) -> MultiIndex:
        """Codebooks from a sample; ``rows`` is how many vectors the model has in all."""
        unit = _unit(vectors).astype(np.float32)
        half = max(1, unit.shape[1] // 2)
        k = centroids_for(rows)
        index = cls(_k_means(unit[:, :half], k), _k_means(unit[:, half:], k) if unit.shape[1] > half else np.zeros((1, 0), np.float32))
        cells, counts = np.unique(np.concatenate([index.cells(unit[lo : lo + 4096]) for lo in range(0, len(unit), 4096)]), return_counts=True)
        parts = np.ceil(counts * (rows / len(unit) / ROWS_PER_SHARD)).astype(int)
        index.parts = dict(zip(cells[parts > 1].tolist(), parts[parts > 1].tolist()))
        return index

    @classmethod
    def trivial(cls, dim: int) -> MultiIndex:
        """One cell."""
        return cls(np.zeros((1, max(1, dim // 2)), np.float32), np.zeros((1, dim - max(1, dim // 2)), np.float32), np.ones(1, np.int32), np.zeros(1, np.int64))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of unit vectors to the centroids of either half."""
        half = self.first.shape[1]
        return _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def divide(self, sizes: np.ndarray) -> None:
        """Takes the cells' sizes."""
        self.sizes, self.full = sizes, np.flatnonzero(sizes)

    def candidates(self) -> int:
        """Entries that a traversal of this index reaches by default."""
        return max(LEAST_CANDIDATES, int(CANDIDATES_PER_ROOT * math.sqrt(self.sizes.sum())))

    def traverse(self, a: np.ndarray, b: np.ndarray, candidates: int) -> list[int]:
        """The cells with entries that one query visits.

        Pairs of centroids come in the order of their summed distance: a heap holds the frontier
        of the two sorted lists of halves. It ends when the visited cells have enough entries.
        """
        width, sizes = len(self.second), self.sizes
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[rows].tolist(), b[columns].tolist()
        rows, columns = rows.tolist(), columns.tolist()
        heap, reached = [(da[0] + db[0], 0, 0)], 0
        visited: list[int] = []
        while heap and reached < candidates:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * width + columns[j]
            n = sizes[cell]
            if n:
                reached += n
                visited.append(cell)
            if j + 1 < len(columns):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return visited

    def traverse_all(self, a: np.ndarray, b: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of what all queries visit, as :meth:`traverse` has it.

        Where few cells have entries, their order is found for many queries at once. Else each query sorts the pairs of
        centroids up to a summed distance, which is raised until their cells have enough entries. Both give what the heap gives, but for ties.
        """
        width = len(self.second)
        if len(self.full) <= SORTED_CELLS:
            sums = a[:, self.full // width] + b[:, self.full % width]
            order = np.argsort(sums, axis=1, kind="stable")
            sizes = self.sizes[self.full][order]
            query, at = np.nonzero(np.cumsum(sizes, axis=1) - sizes < candidates)
            return query, self.full[order[query, at]]
        a, b = a.astype(np.float64), b.astype(np.float64)
        rows, columns = np.argsort(a, axis=1), np.argsort(b, axis=1)
        da, db = np.take_along_axis(a, rows, 1), np.take_along_axis(b, columns, 1)
        visited, reach, usual = [], 0.0, 4 * candidates
        for r, c, x, y in zip(rows, columns, da, db):
            least, trials = x[0] + y[0], 0
            reach = reach or max(1e-9, (x[-1] + y[-1] - least) / 8)
            while True:
                last = least + reach
                wide = np.searchsorted(y, last - x[: np.searchsorted(x, last - y[0], side="right")], side="right")
                pairs = int(wide.sum())
                trials += 1
                if pairs > 2 * usual and trials < 5:  # many more than the query before
                    reach *= max(0.5, (1.3 * usual / pairs) ** 0.25)
                    continue
                trials = 5
                i = np.repeat(np.arange(len(wide)), wide)
                j = np.arange(pairs) - (np.cumsum(wide) - wide).take(i)
                cell = r.take(i) * width + c.take(j)
                sizes = self.sizes.take(cell)
                whole = pairs == len(x) * len(y)
                if whole or sizes.sum() >= candidates:
                    there = np.flatnonzero(sizes)
                    sums = x.take(i.take(there)) + y.take(j.take(there))
                    order = np.argsort(sums)
                    sizes = sizes.take(there.take(order))
                    n = int(np.searchsorted(np.cumsum(sizes) - sizes, candidates))
                    # The last ones could have come before pairs that rounding left out.
                    if whole or sums[order[n - 1]] < last - 1e-12 * abs(last):
                        break
                reach *= 1.1
            visited.append(cell.take(there.take(order[:n])))
            if n:
                reach, usual = 1.06 * max(sums[order[n - 1]] - least, 1e-9), max(16, pairs * n // len(order))
        return np.repeat(np.arange(len(a)), [len(v) for v in visited]), np.concatenate(visited or [np.zeros(0, np.int64)])


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of so many numbers each, in one array."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def centroids_for(rows: int) -> int:
    """Centroids of a half: a power of two that grows with the root of the rows, CENTROIDS at most."""
    return int(min(CENTROIDS, max(1, 2 ** round(math.log2(max(1.0, rows / ROWS_PER_CELL)) / 2))))


def _fit(classes: DataFrame, total: int) -> dict[str, MultiIndex]:
    """A multi-index for each model that isn't small, from a sample of bounded size. At most 1 / LEAST_SHARE models have one."""
    counts = classes.groupBy("model").count().where(F.col("count") >= max(LEAST_ROWS, LEAST_SHARE * total))
    indexes = {}
    for r in counts.toLocalIterator():
        step = max(1, r["count"] // max(TRAINING_ROWS, ROWS_PER_CENTROID * centroids_for(r["count"])))
        sample = classes.where((F.col("model") == r["model"]) & (F.pmod(F.xxhash64("class"), F.lit(step)) == 0)).select("vector").toArrow()
        if sample.num_rows:
            indexes[r["model"]] = MultiIndex.fitted(_matrix(sample.column(0).combine_chunks()), r["count"])
    return indexes


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each model of a batch with its rows; the model is column 0."""
    codes = batch.column(0).dictionary_encode()
    indices = codes.indices.to_numpy()
    for code, model in enumerate(codes.dictionary.to_pylist()):
        yield model, np.flatnonzero(indices == code)


def _scattered(n: np.ndarray) -> np.ndarray:
    return ((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


_LAID = "model string, class bigint, cell bigint, part int, vector binary"


def _cells(batches: Iterator[pa.RecordBatch], indexes: dict[str, MultiIndex]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes with its cell, and its part of a cell that is larger than a shard."""
    for batch in batches:
        cells, parts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
        classes = batch.column(2).to_numpy()
        for model, rows in _by_model(batch):
            if model in indexes:
                for lo in range(0, len(rows), 2048):
                    at = rows[lo : lo + 2048]
                    cells[at] = indexes[model].cells(_unit(_matrix(batch.column(1).take(pa.array(at)))).astype(np.float32))
                for cell, n in indexes[model].parts.items():
                    at = rows[cells[rows] == cell]
                    parts[at] = _scattered(classes[at]) % n
        values = batch.column(1).flatten().to_numpy().astype(np.float32, copy=False)
        ends = 4 * (batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py())
        vectors = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cells), pa.array(parts), vectors], names=["model", "class", "cell", "part", "vector"])


@dataclass
class _Entries:
    """One model's vectors of a shard, in the order of their cells."""

    vectors: np.ndarray
    classes: np.ndarray
    cells: np.ndarray
    begin: np.ndarray
    count: np.ndarray


def _shard(store, path: str, models: set[str] | None = None) -> Iterator[tuple[str, _Entries]]:
    """The models of a shard's file, or those of them that are in ``models``."""
    with store.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        if not file.metadata.num_rows:
            return
        names = file.read(columns=["model"]).column(0).combine_chunks().dictionary_encode()
        if models is not None and models.isdisjoint(names.dictionary.to_pylist()):
            return
        rows = file.read(columns=["class", "cell", "vector"]).combine_chunks()
    codes, classes, cells = names.indices.to_numpy(), rows["class"].to_numpy(), rows["cell"].to_numpy()
    vectors = pa.concat_arrays(rows["vector"].chunks)
    ends = np.frombuffer(vectors.buffers()[1], np.int32, len(codes) + 1, 4 * vectors.offset)
    values = np.frombuffer(vectors.buffers()[2], np.float32, ends[-1] // 4)
    bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for lo, hi in zip(bounds, bounds[1:]):
        name = names.dictionary[int(codes[lo])].as_py()
        if models is None or name in models:
            begin = np.concatenate([[0], np.flatnonzero(np.diff(cells[lo:hi])) + 1])
            yield name, _Entries(values[ends[lo] // 4 : ends[hi] // 4].reshape(hi - lo, -1), classes[lo:hi], cells[lo + begin], begin, np.diff([*begin, hi - lo]))


def _coarse(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        unit = vectors / norms[:, None]
    far = np.flatnonzero(~((norms > 1e-15) & (norms < 1e15)))
    if len(far):
        unit[far] = _unit(vectors[far])
    return unit


class _Queries:
    """Queries of one model in a shard, with the cells that they visit and the nearest entries so far."""

    def __init__(self, classes: np.ndarray, vectors: np.ndarray, index: MultiIndex, candidates: int, k: int) -> None:
        self.own, self.k, n = classes, k, len(classes)
        self.unit = _unit(vectors)
        self.coarse = self.unit.astype(np.float32)
        self.margin = 1e-6 * math.sqrt(self.unit.shape[1])
        bits, visits = n.bit_length(), []
        for lo in range(0, n, QUERIES_PER_PASS):
            query, cell = index.traverse_all(*index.halves(self.coarse[lo : lo + QUERIES_PER_PASS]), candidates)
            visits.append(cell.astype(np.int64) << bits | query + lo)
        keys = np.concatenate(visits)
        del visits
        keys.sort()
        self.query = (keys & ((1 << bits) - 1)).astype(np.int32)
        keys >>= bits
        self.begin = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.zeros(0, np.int64)
        self.cells, self.count = keys[self.begin], np.diff([*self.begin, len(keys)])
        self.bar = np.full(n, -np.inf, np.float32)
        self.best, self.news, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def meet(self, entries: _Entries, coarse: np.ndarray) -> None:
        """Compares the queries with the entries of the cells that they visit.

        Single precision decides what can't be among the nearest; the others are compared in double precision.
        """
        if not len(self.cells):
            return
        at = np.minimum(np.searchsorted(self.cells, entries.cells), len(self.cells) - 1)
        real = np.flatnonzero(self.cells[at] == entries.cells)
        at, begin, count = at[real], entries.begin[real], entries.count[real]
        if not len(at):
            return
        found, held = [], 0
        whole = (count >= ROWS_PER_PRODUCT) & (count * self.count[at] >= PAIRS_PER_PRODUCT)

        def keep(query: np.ndarray, entry: np.ndarray, score: np.ndarray) -> None:
            nonlocal found, held
            other = entries.classes[entry] != self.own[query]
            found.append((query[other], entry[other], score[other]))
            held += len(query)
            if held > SCORES:
                self._compare(entries, found)
                found, held = [], 0

        for place, lo, n in zip(at[whole].tolist(), begin[whole].tolist(), count[whole].tolist()):
            those, asks = coarse[lo : lo + n].T, self.query[self.begin[place] : self.begin[place] + self.count[place]]
            step = max(1, SCORES // n)
            for q in (asks[i : i + step] for i in range(0, len(asks), step)):
                scores = self.coarse[q] @ those
                row, column = np.nonzero(scores >= self.bar[q][:, None])
                if len(row):
                    keep(q[row], column + lo, scores[row, column])
        at, begin, count = at[~whole], begin[~whole], count[~whole]
        if len(at):
            visits = self.count[at]
            asks, begin, count = self.query[_ranges(self.begin[at], visits)], np.repeat(begin, visits), np.repeat(count, visits)
            pairs = np.cumsum(count)
            cuts = [0, *np.unique(np.searchsorted(pairs, np.arange(SCORES, pairs[-1], SCORES))).tolist(), len(asks)]
            for lo, hi in zip(cuts, cuts[1:]):
                query, entry = np.repeat(asks[lo:hi], count[lo:hi]), _ranges(begin[lo:hi], count[lo:hi])
                scores = self._products(coarse, query, entry)
                hit = np.flatnonzero(scores >= self.bar[query])
                if len(hit):
                    keep(query[hit], entry[hit], scores[hit])
        if found:
            self._compare(entries, found)

    def _products(self, coarse: np.ndarray, query: np.ndarray, entry: np.ndarray) -> np.ndarray:
        scores = np.empty(len(query), np.float32)
        one, two = (np.empty((PAIRS_AT_ONCE, coarse.shape[1]), np.float32) for _ in range(2))
        for lo in range(0, len(query), PAIRS_AT_ONCE):
            n = min(PAIRS_AT_ONCE, len(query) - lo)
            np.take(self.coarse, query[lo : lo + n], axis=0, out=one[:n], mode="clip")
            np.take(coarse, entry[lo : lo + n], axis=0, out=two[:n], mode="clip")
            np.vecdot(one[:n], two[:n], out=scores[lo : lo + n])
        return scores

    def _compare(self, entries: _Entries, found: list) -> None:
        query, entry, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-score, query))
        query, entry, score = query[order], entry[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        sizes = np.diff([*first, len(query)])
        last = np.where(sizes >= self.k, score[first + np.minimum(sizes, self.k) - 1], -np.inf)
        near = score >= np.repeat(last, sizes) - 2 * self.margin
        query, entry = query[near].astype(np.int64), entry[near]
        if not len(query):
            return
        those, spot = np.unique(entry, return_inverse=True)
        unit, exact = _unit(entries.vectors[those]), np.empty(len(query))
        for lo in range(0, len(query), PAIRS_AT_ONCE):
            part = slice(lo, lo + PAIRS_AT_ONCE)
            exact[part] = np.einsum("nd,nd->n", self.unit[query[part]], unit[spot[part]])
        self.news.append((query, entries.classes[entry], np.round(np.minimum(exact, 1.0), 12)))
        self.waiting += len(query)
        if self.waiting > len(self.own):
            self._settle()

    def _settle(self) -> None:
        """Cuts the lists to the k nearest and those tied with the last."""
        query, other, exact = (np.concatenate(x) for x in zip(self.best, *self.news))
        order = np.lexsort((-exact, query))
        query, other, exact = query[order], other[order], exact[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        sizes = np.diff([*first, len(query)])
        last = np.where(sizes >= self.k, exact[first + np.minimum(sizes, self.k) - 1], -np.inf)
        stay = exact >= np.repeat(last, sizes)
        self.best, self.news, self.waiting = (query[stay], other[stay], exact[stay]), [], 0
        self.bar[query[first]] = last - self.margin

    def rows(self) -> pa.RecordBatch:
        self._settle()
        query, other, exact = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.own[query]), pa.array(other), pa.array(exact)], names=["class", "other", "similarity"])


def _searched(turns: Iterator[pa.RecordBatch], paths: list[str], indexes: dict[str, MultiIndex], candidates: int | None, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each vector of a shard: it reads the shards one after another, its own first."""
    store, _ = pa.fs.FileSystem.from_uri(paths[0])
    files = [pa.fs.FileSystem.from_uri(p)[1] for p in paths]
    for turn in (n for batch in turns for n in batch.column(0).to_pylist()):
        asked: dict[str, list[_Queries]] = {}
        for model, own in _shard(store, files[turn]):
            index = indexes.get(model) or MultiIndex.trivial(own.vectors.shape[1])
            n = candidates or index.candidates()
            step = max(1, min(ROWS_PER_SHARD, VISITS // n))
            asked[model] = [_Queries(own.classes[lo : lo + step], own.vectors[lo : lo + step], index, n, k) for lo in range(0, len(own.classes), step)]
        for file in (files[turn:] + files[:turn]) if asked else []:
            for model, entries in _shard(store, file, set(asked)):
                coarse = _coarse(entries.vectors)
                for one in asked[model]:
                    one.meet(entries, coarse)
        for own in asked.values():
            for one in own:
                yield one.rows()


def passes_for(copies: float, rows: int, row_bytes: float) -> int:
    """Passes in which vectors go to the shards, each to so many on average, so that a pass moves a bounded share of the vectors' bytes."""
    return max(1, math.ceil(copies * rows * row_bytes / max(PASS_SHARE * rows * row_bytes, PASS_BYTES)))


def nearest_classes(classes: DataFrame, k: int, candidates: int | None = None, spent: DataFrame | None = None) -> DataFrame:
    """``class, other, similarity``: for each class the k most similar others, and those tied with the last.

    ``classes`` has ``model, class bigint, vector``; only vectors of one model are compared,
    and all of a model have one length.

    The vectors are laid out once, in files of whole cells, the shards. A task has a shard's vectors as queries: it finds the cells that each
    visits, reads all shards itself and compares a cell's entries with the queries that visit it, so that a query is neither shuffled to
    the cells it visits nor compared with others. ``spent`` is a table that is released as soon as the vectors are laid out.
    """
    spark = classes.sparkSession
    total, numbers = classes.agg(F.count("*"), F.sum(F.size("vector"))).first()
    indexes = _fit(classes, total)
    codebooks = spark.sparkContext.broadcast(indexes)
    rows = max(1, min(ROWS_PER_SHARD, max(LEAST_PER_SHARD, -(-total // SHARDS))))
    passes = passes_for(1, total, 4 * (numbers or 0) / max(1, total))
    shards = max(1, -(-total // (rows * passes)))

    def laid_out(turn: int) -> DataFrame:
        own = classes.where(F.pmod(F.xxhash64("class"), F.lit(passes)) == turn) if passes > 1 else classes
        cells = own.select("model", "vector", "class").mapInArrow(lambda it: _cells(it, codebooks.value), _LAID)
        return as_table(cells.repartition(shards, "model", "cell", "part").sortWithinPartitions("model", "cell"), "vector-shards", freed=True, rows_per_file=2 * rows)

    tables = [laid_out(turn) for turn in range(passes)]
    if spent is not None:
        release(spent)
    sizes = {model: np.zeros(len(x.first) * len(x.second), np.int32) for model, x in indexes.items()}
    for table in tables:
        for batch in table.groupBy("model", "cell").count().where(F.col("model").isin(list(indexes) or [""])).toArrow().to_batches():
            for model, at in _by_model(batch):
                np.add.at(sizes[model], batch.column(1).to_numpy()[at], batch.column(2).to_numpy()[at].astype(np.int32))
    for model, index in indexes.items():
        index.divide(sizes[model])
    divided = spark.sparkContext.broadcast(indexes)
    folders = [qualified(spark, table._mnemoframe_path) for table in tables]
    paths = [f"{folder}/{name}" for folder in folders for name in sorted(entries_of(spark, folder)) if name.endswith(".parquet")]
    out = "class bigint, other bigint, similarity double"
    if not paths:
        return spark.createDataFrame([], out)
    found = as_table(spark.range(0, len(paths), 1, len(paths)).mapInArrow(lambda it: _searched(it, paths, divided.value, candidates, k), out), "nearest", freed=True)
    release(*tables)
    return found


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two hashes of a vector's direction: vectors that are positive multiples by powers of two have equal ones."""
    for batch in batches:
        hashes = np.zeros((2, batch.num_rows), np.uint64)
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            matrix = _matrix(batch.column(2).take(pa.array(at))).astype(np.float64)
            bits = (matrix / np.abs(matrix).max(axis=1, keepdims=True) + 0.0).view(np.uint64)
            for i in range(2):
                draw = np.random.default_rng(100 + i)
                mixed = (bits ^ (bits >> np.uint64(29))) * (draw.integers(1 << 62, 1 << 63, n, np.uint64) | np.uint64(1))
                hashes[i, at] = ((mixed ^ (mixed >> np.uint64(32))) * (draw.integers(1 << 62, 1 << 63, n, np.uint64) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(h.view(np.int64)) for h in hashes)], names=["id", "model", "vector", "h1", "h2"])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by model, direction and id: numbers the directions, and the ids of each; the first keeps its vector."""
    number, place, before = (TaskContext.get().partitionId() << 40) - 1, 0, None
    for batch in batches:
        keys = list(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()))
        classes, places = [], []
        for key in keys:
            number, place = (number, place + 1) if key == before else (number + 1, 1)
            before = key
            classes.append(number), places.append(place)
        vectors = batch.column(2).take(pa.array(np.arange(batch.num_rows), mask=np.array(places) > 1))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(classes, pa.int64()), pa.array(places, pa.int64()), batch.column(0), vectors], names=["model", "class", "n", "id", "vector"])


def nearest_vectors(rows: DataFrame, id: str, model: str, vector: str, k: int = 5, candidates: int | None = None) -> DataFrame:
    """``id, other, similarity, rank``: the k most similar ids of the same model for every id.

    Similarity is the cosine to twelve places; on ties the alphabetically first id comes first. ``rows`` has one
    usable vector (:func:`usable_vector`) per id; vectors of one model but different lengths are never compared. Null ids or
    models don't count. A model with one id has no rows.

    Inverted multi-index: both halves of the unit vectors are quantised separately, the
    codebooks being fitted on a sample of TRAINING_ROWS; every vector is then indexed. For each
    query the pairs of centroids are traversed in the order of their summed distance with a
    heap, until their cells hold ``candidates`` entries. Just the entries of these cells are reranked by
    exact cosine. Whole cells lie in shards; a cell that is too large for a shard has several. Centroids grow with the root of a model's
    vectors, shards with their number. Vectors of one direction are one class in
    the index, of which the first k + 1 ids are kept, as no list needs more. What goes to the driver and to the
    workers is the cells' sizes, at most CENTROIDS squared a model.
    """
    rows = rows.select(F.col(id).cast("string").alias("id"), F.col(model).cast("string").alias("model"), F.col(vector).cast("array<float>").alias("vector")).where("id IS NOT NULL AND model IS NOT NULL")
    named = rows.withColumn("model", F.concat_ws("\x1f", "model", F.size("vector").cast("string"))).mapInArrow(_directions, "id string, model string, vector array<float>, h1 bigint, h2 bigint")
    ordered = named.repartition("model", "h1", "h2").sortWithinPartitions("model", "h1", "h2", "id")
    table = as_table(ordered.mapInArrow(_classed, "model string, class bigint, n bigint, id string, vector array<float>"), "vector-classes", freed=True)
    members = as_table(table.select("class", "n", "id"), "vector-members")
    # Classes tied at the end of the list may hold earlier ids: all of them stay until ids are known.
    ranked = nearest_classes(table.where("n = 1").select("model", "class", "vector"), k, candidates, table)
    heads = members.where(F.col("n") <= k + 1).select("class", "id")
    own = heads.select("class", F.col("id").alias("other_id"), F.lit(1.0).alias("similarity"))
    listed = ranked.join(heads.select(F.col("class").alias("other"), F.col("id").alias("other_id")), "other").select("class", "other_id", "similarity").unionByName(own)
    order = Window.partitionBy("class").orderBy(F.desc("similarity"), "other_id")
    lists = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("class", F.col("other_id").alias("other"), "similarity", "n")
    paired = members.drop("n").join(lists, "class").where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return paired.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def _exact(batches: Iterator[pa.RecordBatch], asked: dict[str, tuple[list[str], np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for model, rows in _by_model(batch):
            if model not in asked:
                continue
            names, unit = asked[model]
            ids = np.array(batch.column(1).take(pa.array(rows)).to_pylist(), object)
            scores = _unit(_matrix(batch.column(2).take(pa.array(rows)))) @ unit.T
            scores[ids[:, None] == np.array(names, object)[None, :]] = -np.inf
            most = min(k, len(rows))
            row, query = np.nonzero((scores >= -np.partition(-scores, most - 1, axis=0)[most - 1]) & np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], pa.string()), pa.array(ids[row].tolist(), pa.string()), pa.array(np.round(np.minimum(scores[row, query], 1.0), 12))], names=["id", "other", "similarity"])


def measured_loss(rows: DataFrame, found: DataFrame, id: str, model: str, vector: str, k: int = 5, every: int = 50, most: int = 4096) -> DataFrame:
    """``asked, wanted, found, recall, loss`` in one row: how much of the exact lists ``found`` has.

    Asked are the ids whose hash is divisible by ``every``. Their exact lists come from the product of
    their vectors, in blocks of ``most``, with those of all rows. No ids give a null recall.
    """
    spark = rows.sparkSession
    rows = rows.select(F.concat_ws("\x1f", F.col(model), F.size(vector).cast("string")).alias("model"), F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & F.col(model).isNotNull())
    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    exact, block = spark.createDataFrame([], "id string, other string, similarity double"), []

    def compared(block):
        by_model: dict[str, list] = {}
        for r in block:
            by_model.setdefault(r["model"], []).append((r["id"], r["vector"]))
        shared = spark.sparkContext.broadcast({m: ([i for i, _ in own], _unit(np.array([v for _, v in own], np.float32))) for m, own in by_model.items()})
        return rows.mapInArrow(lambda it: _exact(it, shared.value, k), "id string, other string, similarity double")

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == most:
            exact, block = exact.unionByName(compared(block)), []
    if block:
        exact = exact.unionByName(compared(block))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    wanted = exact.withColumn("n", best).where(F.col("n") <= k).select("id", "other")
    met = wanted.join(found.select("id", "other").withColumn("_hit", F.lit(1)), ["id", "other"], "left")
    sums = met.agg(F.count_distinct("id").alias("asked"), F.count("*").alias("wanted"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"))
    recall = F.try_divide("found", "wanted")
    return sums.select("asked", "wanted", "found", recall.alias("recall"), (1 - recall).alias("loss"))


def latest_vectors(rows: DataFrame, id: Column, version: str = "mtime") -> DataFrame:
    """``id, model, dim, vector``: per id the row with the greatest version, if its vector is usable.

    Of several such rows the greatest by model, length and vector stands. Null versions come first.
    """
    newest = rows.select(id.alias("id"), F.struct(F.col(version), "model", "dim", "vector").alias("row")).where("id IS NOT NULL").groupBy("id").agg(F.max("row").alias("row"))
    return newest.select("id", "row.model", "row.dim", "row.vector").where(usable_vector("vector", "dim"))
