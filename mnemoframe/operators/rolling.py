"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the dense day axis that one numpy pass handles; bounds a worker's memory.
CELLS_PER_PASS = 2_000_000

#: Takes the day's own total and the totals by window; returns a mask of the rows to keep.
Keep = Callable[[np.ndarray, dict[int, np.ndarray]], np.ndarray]


def doubled_sums(cells: np.ndarray, windows: Sequence[int]) -> dict[int, np.ndarray]:
    """Trailing sums of ``cells`` for each window, by binary doubling.

    The sums of 1, 2, 4, 8, ... cells each come from the one before, shifted by its length. A
    window is put together from the blocks of its binary digits, each shifted past the others.
    Cells before the first count as zero.
    """
    if any(w < 1 for w in windows):
        raise ValueError("a window covers at least one day")
    blocks, length = [cells], 1
    while length * 2 <= max(windows):
        blocks.append(_shifted_add(blocks[-1], blocks[-1], length))
        length *= 2
    sums = {}
    for w in windows:
        total, done = None, 0
        for bit in reversed(range(len(blocks))):
            if w >> bit & 1:
                total = blocks[bit].copy() if total is None else _shifted_add(total, blocks[bit], done)
                done += 1 << bit
        sums[w] = total
    return sums


def _shifted_add(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    out = a.copy()
    if by < len(b):
        out[by:] += b[: len(b) - by]
    return out


def _passes(starts: np.ndarray, cells: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of segments of at most so many cells; a longer segment is a run of its own."""
    lo = 0
    while lo < len(starts):
        base = cells[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cells, base + most, side="right")))
        yield lo, hi
        lo = hi


def _roll(batches: Iterator[pa.RecordBatch], windows: tuple[int, ...], last_day: int, every_day: bool, keep: Keep | None, schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    pad = max(windows) - 1
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], lists.flatten()
        if not len(flat):
            continue
        day = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        value = flat.field(1).to_numpy(zero_copy_only=False)
        of_key = np.repeat(np.arange(len(keys)), np.diff(offsets))
        new = np.ones(len(day), bool)
        same_key = of_key[1:] == of_key[:-1]
        new[1:] = ~same_key if every_day else ~same_key | (day[1:] - day[:-1] > pad)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(day)) - 1
        until = np.full(len(start), last_day) if every_day else np.minimum(last_day, day[end] + pad)
        until = np.maximum(until, day[end])
        span = until - day[start] + 1
        for lo, hi in _passes(start, np.cumsum(span + pad), most):
            place = np.concatenate([[0], np.cumsum(span[lo:hi] + pad)])
            rows = slice(start[lo], end[hi - 1] + 1)
            segment = np.cumsum(new[rows]) - 1
            cells = np.zeros(place[-1], value.dtype)
            cells[place[segment] + day[rows] - day[start[lo:hi]][segment]] = value[rows]
            sums = doubled_sums(cells, windows)
            real = np.repeat(place[:-1], span[lo:hi]) + _counted(span[lo:hi])
            at = np.repeat(np.arange(lo, hi), span[lo:hi])
            own, sums = cells[real], {w: s[real] for w, s in sums.items()}
            dates = day[start[at]] + _counted(span[lo:hi])
            mask = dates <= last_day
            if keep is not None:
                mask &= keep(own, sums)
            rows_of = of_key[start[at[mask]]]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows_of)), pa.array(dates[mask].astype(np.int32)).cast(pa.date32()), pa.array(own[mask])]
                + [pa.array(sums[w][mask]) for w in windows],
                schema=schema,
            )


def _counted(spans: np.ndarray) -> np.ndarray:
    """0, 1, ... within each span, one span after the other."""
    ends = np.cumsum(spans)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - spans, spans)


def rolling_totals(
    df: DataFrame,
    key: Column | str,
    epoch_day: Column | str,
    value: Column | str | None = None,
    windows: Sequence[int] = (7, 30),
    last_day: int | None = None,
    every_day: bool = True,
    keep: Keep | None = None,
) -> DataFrame:
    """Per key and day the day's total and the total of each trailing window.

    Returns ``key string, day date, total, total_<w>...``. A key's days run from its first day
    to ``last_day``, by default the last day of the whole input. ``every_day=False`` leaves out
    the days whose windows are all empty (the totals there are zero). ``keep`` restricts the
    rows before they leave the worker. Without ``value`` rows are counted; else it is summed as
    double, null counting as zero.

    Rows with a null key or day don't count. No rows give no rows. Days after ``last_day`` don't
    come out.

    Scale: rows are pre-aggregated by (key, day) on the map side, so that a hot key reaches
    one task as at most one row a day. The dense day axis exists only in numpy passes of
    bounded length.
    """
    windows = tuple(dict.fromkeys(int(w) for w in windows))
    key = F.col(key) if isinstance(key, str) else key
    epoch_day = F.col(epoch_day) if isinstance(epoch_day, str) else epoch_day
    measure = F.lit(1).cast("long") if value is None else F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(0.0))
    rows = df.select(key.cast("string").alias("key"), epoch_day.cast("int").alias("day"), measure.alias("v")).where("key IS NOT NULL AND day IS NOT NULL")
    daily = rows.groupBy("key", "day").agg(F.sum("v").alias("v"))
    if last_day is None:
        last_day = rows.agg(F.max("day")).first()[0]
        last_day = -1 if last_day is None else last_day
    series = daily.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "v"))).alias("series"))
    kind, arrow_kind = ("bigint", pa.int64()) if value is None else ("double", pa.float64())
    schema = pa.schema([("key", pa.string()), ("day", pa.date32()), ("total", arrow_kind)] + [(f"total_{w}", arrow_kind) for w in windows])
    ddl = f"key string, day date, total {kind}, " + ", ".join(f"total_{w} {kind}" for w in windows)
    most = CELLS_PER_PASS
    return series.mapInArrow(lambda it: _roll(it, windows, last_day, every_day, keep, schema, most), ddl)
