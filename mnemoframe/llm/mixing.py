"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release

#: A rank file of a public tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Aimed at rows in a block of a prefix sum.
BLOCK_ROWS = 50_000
#: Longer texts are cut between pre-tokens, as the tokenizer's own splitting overflows on very long runs of white space.
LONG = 1 << 16

_ENCODING: dict[str, object] = {}


def _encoding(path: str, content: bytes | None = None):
    """The encoding of a rank file, made once in each process; ``content`` is the file's, where it can't be read here."""
    if path not in _ENCODING:
        import tiktoken

        lines = (Path(path).read_bytes() if content is None else content).splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _ENCODING[path] = tiktoken.Encoding("rank-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


def token_count(text: str, path: str = TOKENIZER, long: int = LONG) -> int:
    """Tokens of the whole text. Merges never cross pre-tokens, so that cutting between these changes nothing."""
    encoding = _encoding(path)
    if len(text) <= long:
        return len(encoding.encode_ordinary(text))
    single = lambda b, e: len(encoding._encode_single_piece(text[b:e].encode("utf-8", "replace")))
    total = start = 0
    spaces: list[tuple[int, int]] = []  # white space since the last other pre-token; how it splits depends on what follows
    for token in _split().finditer(text):
        begin, end = token.span()
        blank = token.lastindex == 1
        if end - begin > long:
            total += len(encoding.encode_ordinary(text[start : spaces[0][0] if spaces else begin])) + sum(single(b, e) for b, e in spaces) + single(begin, end)
            start, spaces = end, []
        elif blank:
            spaces.append((begin, end))
        else:
            if end - start > long:
                total += len(encoding.encode_ordinary(text[start:end]))
                start = end
            spaces = []
    return total + len(encoding.encode_ordinary(text[start:]))


@functools.cache
def _split():
    """The tokenizer's pattern, with white space as it has it; group 1 is set where a pre-token is white space."""
    import regex

    words, blank, rest = SPLIT.rsplit("|", 2)
    white = lambda p: p.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(white(f"{words}|({blank}|{rest})"))


def with_tokens(documents: DataFrame, path: str = TOKENIZER, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, source, tokens``: the source trimmed and lower-cased, the text's tokens counted.

    A null or empty text has no tokens. Texts stay where they were read. The rank file is read by
    the driver and goes out with the tasks; it has about a megabyte.
    """
    label = F.lower(F.btrim(F.col(source)))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), label.alias("source"), F.col(text).cast("string").alias("text"))

    ranks = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoding(path, ranks.value)
        for batch in batches:
            counts = [token_count(t.as_py() or "", path) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    return rows.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


def _running(rows: DataFrame, group: list[str], block: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the running total of ``size`` per group, in two levels so that no group is one task.

    ``block`` follows ``order``. Blocks are summed first, their totals run up, and the rows then
    run up within their block.
    """
    sums = rows.groupBy(*group, block).agg(F.sum(size).alias("_block_sum"))
    before = F.coalesce(F.sum("_block_sum").over(Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*group, block, before.alias("_before"))
    within = F.sum(size).over(Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_within", within).join(starts, [*group, block]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def weighted_mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """The mixture as rows ``position_key double, source, doc_id, repeat, tokens``, in order.

    ``counted`` comes from :func:`with_tokens`; ``targets`` has ``source, target_share,
    max_repeats``. Each source's documents are shuffled by a seeded hash, once per repeat, a
    repeat after the one before. A document's virtual finish time is its source's tokens so far
    divided by the source's target share. All are sorted by that time and cut where the total
    would be exceeded, so that every source that has enough tokens left has its share at each
    point. ``total_tokens`` is by default what the listed sources hold once.

    Sources are compared trimmed and lower-cased. Documents of unlisted or null sources, with a
    null id or without tokens aren't taken, nor are sources with a null or non-positive share;
    null repeats mean one. A source listed twice has the sum of its shares and its largest repeats. A
    document with several rows has the first by source and tokens. An empty side gives no rows.

    Scale: only ids and counts are shuffled, never texts. Running totals are built in blocks,
    so that neither a source with a third of all rows nor the final sort is ever one task. Of a source's
    repeats only those are made that begin before the virtual time by which the budget is surely
    spent, however many are allowed. The targets are joined by whatever join their size allows.
    """
    spark = counted.sparkSession
    targets = (
        targets.select(F.lower(F.btrim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats"))
        .where("source IS NOT NULL AND share > 0 AND NOT isnan(share) AND repeats > 0")
        .groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    )
    named = counted.where("doc_id IS NOT NULL AND tokens > 0 AND source IS NOT NULL").join(targets, "source")
    one = named.groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "share", "repeats")).alias("d"))
    listed = as_table(one.select("doc_id", "d.*"), "mix-counts")
    rows, held = listed.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    total = held if total_tokens is None else int(total_tokens)
    if not rows or total <= 0:
        return spark.createDataFrame([], "position_key double, source string, doc_id bigint, repeat int, tokens bigint")
    blocks = max(1, -(-rows // BLOCK_ROWS))
    key = F.xxhash64(F.lit(seed), "doc_id")
    shuffled = listed.withColumn("key", key).withColumn("block", F.least(F.floor((F.col("key").cast("double") / F.lit(2.0**64) + 0.5) * blocks), F.lit(blocks - 1)).cast("int"))
    once = _running(shuffled, ["source"], "block", ["key", "doc_id"], "tokens", "so_far")
    sources = as_table(listed.groupBy("source").agg(F.first("share").alias("share"), F.first("repeats").alias("repeats"), F.sum("tokens").alias("whole"), F.max("tokens").alias("largest")), "mix-sources")
    caps = [(r["share"], r["whole"] * r["repeats"], r["largest"]) for r in sources.toLocalIterator()]
    near = _time_at([(share, most) for share, most, _ in caps], total)
    # A source lags behind its share by less than its largest document.
    spent = _time_at([(share, most) for share, most, _ in caps], total + sum(largest for _, _, largest in caps))
    begun = F.least(F.col("repeats").cast("double"), F.floor(F.lit(spent * (1 + 1e-9)) * F.col("share") / F.col("whole")) + 1).cast("int")
    copies = once.drop("share", "repeats").join(sources.select("source", "share", "whole", begun.alias("begun")), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("begun"))))
    timed = copies.select("source", "doc_id", "repeat", "tokens", (((F.col("repeat") - 1) * F.col("whole") + F.col("so_far")) / F.col("share")).alias("position_key"))
    timed = as_table(timed, "mix-times")
    release(listed, sources)
    parts = blocks * 4
    time = F.col("position_key") / F.lit(near)
    part = F.when(time < 1, F.floor(time * parts)).otherwise(parts + F.floor(F.log2(time) * 4096)).cast("long")
    cut_order = timed.withColumn("part", part)
    sums = cut_order.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = sums.select("part", "n", before.alias("before")).where(F.col("before") < total)
    running = F.sum("tokens").over(Window.partitionBy("part").orderBy("position_key", "source", "doc_id", "repeat").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = cut_order.join(bounds, "part").withColumn("upto", F.col("before") + running).where(F.col("upto") <= total)
    return taken.select("position_key", "source", "doc_id", "repeat", "tokens").orderBy("position_key", "source", "doc_id", "repeat")


def _time_at(caps: list[tuple[float, int]], total: int) -> float:
    """The virtual time at which sources of these (share, most tokens) have given ``total`` together.

    ``caps`` has a row for each listed source.
    """
    low, high = 0.0, max(most / share for share, most in caps)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(share * mid, most) for share, most in caps) >= total else (mid, high)
    return high


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, documents, tokens, actual_share, most_repeats`` of each listed source."""
    targets = targets.select(F.lower(F.btrim("source")).alias("source"), "target_share").where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    sums = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("repeat").alias("most_repeats"))
    joined = targets.join(sums, "source", "left").fillna(0, ["documents", "tokens", "most_repeats"])
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy()).cast("double"))
    return joined.select("source", "target_share", "documents", "tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "most_repeats")
