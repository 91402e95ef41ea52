"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table, release

#: Characters that one numpy pass of the fingerprints handles; bounds a worker's memory.
CHARS_PER_PASS = 1_000_000
#: Texts that are streamed through one copy of a reference shard's automaton.
TEXTS_PER_COPY = 512
#: Characters of a reference text whose anchors belong to one shard; bounds an automaton.
SHARD_CHARS = 20_000
#: Characters of a reference that are added at a time.
CHARS_PER_STEP = 1024
#: Bits of the filter that goes to the workers, a power of two of at least 32768; the filter has an eighth as many bytes, however many texts there are.
FILTER_BITS = 1 << 24

_BASE = 0xD6E8FEB86659FD93
_MIX = 0x9E3779B97F4A7C15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class SuffixAutomaton:
    """The automaton of all substrings of some texts, built character by character.

    Each state stands for the substrings that end at the same places; ``length`` is its longest
    one, ``link`` the state of the longest suffix that ends at more places, ``first_end`` where
    it first ends in the joined texts.
    """

    def __init__(self, texts: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first_end = [0]
        self.size = 0
        for text in texts:
            self.add(text)

    def add(self, text: str) -> None:
        last = 0
        for c in text:
            self.size += 1
            last = self._extend(last, c, self.size)

    def _state(self, length: int, link: int, moves: dict[str, int], end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.first_end.append(end)
        return len(self.length) - 1

    def _split(self, above: int, c: str, target: int) -> int:
        """A copy of ``target`` that holds only the substrings that go on from ``above``."""
        copy = self._state(self.length[above] + 1, self.link[target], dict(self.next[target]), self.first_end[target])
        self.link[target] = copy
        moves, link = self.next, self.link
        while above >= 0 and moves[above].get(c) == target:
            moves[above][c] = copy
            above = link[above]
        return copy

    def _extend(self, last: int, c: str, at: int) -> int:
        moves, link, length = self.next, self.link, self.length
        there = moves[last].get(c)
        if there is not None:  # a further text that begins like one before
            return there if length[there] == length[last] + 1 else self._split(last, c, there)
        new = self._state(length[last] + 1, 0, {}, at)
        above = last
        while above >= 0:
            there = moves[above].get(c)
            if there is not None:
                break
            moves[above][c] = new
            above = link[above]
        if above >= 0:
            link[new] = there if length[there] == length[above] + 1 else self._split(above, c, there)
        return new

    def windows(self, text: str, width: int) -> list[tuple[int, int, int]]:
        """``(begin, end, place)`` of the runs of ``text`` whose windows of that width occur here one after the other.

        The text runs through the automaton, and the matching statistic, the longest match that
        ends at each position, is kept at the width at most: the state then stands for the
        last window, and ``first_end`` tells where that occurs first. ``place`` is where
        the run's first window begins in the joined texts. Equal windows of any texts
        have equal places.
        """
        moves, link, length, first_end = self.next, self.link, self.length, self.first_end
        state = matched = 0
        found: list[tuple[int, int, int]] = []
        begin = place = upto = -1
        for end, c in enumerate(text, 1):
            there = moves[state].get(c)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = moves[state].get(c)
            if there is None:  # not a character of these texts
                continue
            state = there
            matched += 1
            if matched > width:
                matched = width
                while length[link[state]] >= width:
                    state = link[state]
            if matched == width:
                at = first_end[state]
                if end == upto + 1 and at - end == place - begin:
                    upto = end
                    continue
                if upto >= 0:
                    found.append((begin, upto, place))
                begin, upto, place = end - width, end, at - width
        if upto >= 0:
            found.append((begin, upto, place))
        return found


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k codes, put together from runs of powers of two."""
    hashes = codes.astype(np.uint64)
    hashes *= np.uint64(_MIX)
    hashes ^= hashes >> np.uint64(29)
    total, total_len, length = None, 0, 1
    while True:
        if k & length:
            if total is None:
                total = hashes
            else:
                n = len(hashes) - total_len
                total = total[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + hashes[total_len : total_len + n]
            total_len += length
        if length * 2 > k:
            break
        hashes = hashes[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + hashes[length:]
        length *= 2
    total = total ^ (total >> np.uint64(32))
    total *= np.uint64(_MIX)
    return total ^ (total >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of ``width`` values, by doubling."""
    length = 1
    while length * 2 <= width:
        values = pick(values[:-length], values[length:])
        length *= 2
    rest = width - length
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(text_codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, position, end position, hash)`` of the anchors of joined texts.

    In each window of ``least`` characters the k-gram with the smallest hash is an anchor, all of them on a tie.
    Equal windows thus have equal anchors at equal places. Neighbouring anchors with equal
    hashes come as one row from the first to the last.
    """
    grams = least - k + 1
    empty = np.zeros(0, np.int64)
    if len(text_codes) < least:
        return empty, empty, empty, empty
    hashes = _gram_hashes(text_codes, k)
    # Hashes are kept above zero, which stands for "no window here" below.
    hashes |= np.uint64(1)
    smallest = _sliding(hashes, grams, np.minimum)
    windows = np.maximum(lengths - least + 1, 0)
    usable = np.zeros(len(text_codes) + 1, np.int32)
    np.add.at(usable, starts[windows > 0], 1)
    np.add.at(usable, (starts + windows)[windows > 0], -1)
    smallest = np.where(np.cumsum(usable[: len(smallest)]) > 0, smallest, np.uint64(0))
    padded = np.concatenate([np.zeros(grams - 1, np.uint64), smallest, np.zeros(grams - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, grams, np.maximum)[: len(hashes)] == hashes)
    if not len(at):
        return empty, empty, empty, empty
    of = np.searchsorted(starts, at, side="right") - 1
    values = hashes[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(at)) - 1
    return of[first], at[first] - starts[of[first]], at[final] - starts[of[first]], values[first].view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], least: int, k: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts in column 1; column 0 names the text, column 2 its offset in the record."""
    for batch in batches:
        pieces: list[tuple[int, int, str]] = []
        size = 0

        def flush():
            codes = np.frombuffer("".join(t for _, _, t in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.array([len(t) for _, _, t in pieces], np.int64)
            starts = np.cumsum(lengths) - lengths
            of, begin, end, value = anchors(codes, starts, lengths, least, k)
            row = np.array([r for r, _, _ in pieces], np.int64)[of]
            offset = np.array([o for _, o, _ in pieces], np.int64)[of]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(value), pa.array(begin + offset), pa.array(end + offset)], names=["class", "anchor", "first", "last"]
            )

        for r, text in enumerate(batch.column(1)):
            text, base = text.as_py(), batch.column(2)[r].as_py()
            if text is None or len(text) < least:
                continue
            for i in range(0, max(1, len(text) - least + 1), chars):
                piece = text[i : i + chars + least - 1]
                pieces.append((r, base + i, piece))
                size += len(piece)
                if size >= chars:
                    yield flush()
                    pieces, size = [], 0
        if pieces:
            yield flush()


_ANCHORS = "class binary, anchor bigint, first bigint, last bigint"


def _shared(rows: DataFrame) -> DataFrame:
    """The anchors that different texts have."""
    both = rows.groupBy("anchor").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("anchor")
    return rows.join(both, "anchor")


def _stretches(places: list[tuple[int, int]], k: int, least: int, size: int) -> list[tuple[int, int]]:
    """What lies around anchors at (first, last): all windows that can have one of them, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(places):
        lo, hi = max(0, first + k - least), min(size, last + least)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return [(lo, hi) for lo, hi in out if hi - lo >= least]


def _cut(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """The stretches of a text around its anchors, per group of anchors.

    Columns are the text's key, the text, where it begins in the record, and the anchors as group (the reference's key and shard, null
    for all together), first and last.
    """
    for batch in batches:
        of, refs, shards, begins, parts = [], [], [], [], []
        for r, (text, base, places) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3))):
            text = text.as_py()
            groups: dict[tuple, list[tuple[int, int]]] = {}
            for p in places.as_py():
                groups.setdefault((p["ref"], p["shard"]), []).append((p["first"], p["last"]))
            for (ref, shard), own in groups.items():
                for lo, hi in _stretches([(first - base, last - base) for first, last in own if first >= base and last - base < len(text)], k, least, len(text)):
                    of.append(r), refs.append(ref), shards.append(shard), begins.append(base + lo), parts.append(text[lo:hi])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of, pa.int64())), pa.array(refs, pa.binary()), pa.array(shards, pa.int64()), pa.array(begins, pa.int64()), pa.array(parts, pa.string())],
            names=["class", "ref", "shard", "begin", "text"],
        )


_PIECES = "class binary, ref binary, shard bigint, begin bigint, text string"
_MATCHES = pa.schema([("ref", pa.binary()), ("ref_begin", pa.int64()), ("class", pa.binary()), ("begin", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])
_MATCHES_DDL = "ref binary, ref_begin bigint, class binary, begin bigint, end bigint, window binary"


def _window_names(text: str, width: int) -> np.ndarray:
    """16 bytes for each window of the text: two hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.stack([_gram_hashes(codes, width), _gram_hashes(codes ^ np.uint32(0x5BD1E995), width)], axis=1)


def _reference(pieces: list[tuple[int, str]], least: int) -> tuple[SuffixAutomaton, np.ndarray, np.ndarray]:
    """The automaton of a reference's pieces, and where its texts begin in it and in the record.

    Parts whose windows are all in it already, as in long periodic runs, aren't added again.
    """
    automaton, begins, sizes = SuffixAutomaton([]), [], []
    for begin, text in pieces:
        for at in range(0, len(text) - least + 1, CHARS_PER_STEP):
            part = text[at : at + CHARS_PER_STEP + least - 1]
            if sum(end - start - least + 1 for start, end, _ in automaton.windows(part, least)) < len(part) - least + 1:
                automaton.add(part)
                begins.append(begin + at), sizes.append(len(part))
    return automaton, np.cumsum([0] + sizes[:-1]), np.array(begins, np.int64)


def _match(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (ref, shard, copy, class, begin, text) come sorted by the first three, the reference's own pieces first.

    What of a text occurs in the reference goes out as runs, with the reference's place; windows
    that don't go out by their names. Of the reference itself windows go out that it has had before.
    """
    key, pieces, reference = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if (row["ref"], row["shard"], row["copy"]) != key:
                key, pieces, reference = (row["ref"], row["shard"], row["copy"]), [], None
            if row["class"] == row["ref"]:
                pieces.append((row["begin"], row["text"]))
                continue
            if reference is None:
                reference = automaton, starts, begins = _reference(pieces, least)
                for begin, text in pieces if row["copy"] == 0 else ():
                    for lo, hi, place in automaton.windows(text, least):
                        part = int(np.searchsorted(starts, place, side="right")) - 1
                        at = int(begins[part] + place - starts[part])
                        if at != begin + lo:
                            out.append((row["ref"], at, row["ref"], begin + lo, begin + hi, None))
            names, upto, text = None, 0, row["text"]
            for lo, hi, place in [*automaton.windows(text, least), (len(text) - least + 1, None, None)]:
                if lo > upto:
                    names = _window_names(text, least) if names is None else names
                    out += [(None, None, row["class"], row["begin"] + at, row["begin"] + at + least, names[at].tobytes()) for at in range(upto, lo)]
                if hi is not None:
                    part = int(np.searchsorted(starts, place, side="right")) - 1
                    out.append((row["ref"], int(begins[part] + place - starts[part]), row["class"], row["begin"] + lo, row["begin"] + hi, None))
                    upto = hi - least + 1
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_MATCHES)], schema=_MATCHES)


def text_classes(documents: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class``: documents of at least that length; exact copies share a class."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("class"), F.length(text).alias("n_chars"))
    return rows.where(F.col("doc_id").isNotNull() & (F.col("n_chars") >= least)).select("doc_id", "class").distinct()


def _filtered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most of those whose class isn't among the wanted ones, by a filter of FILTER_BITS bits.

    The bits are set by Spark's bitmap aggregate and go out as rows of 4 KB.
    """
    bit = lambda: F.conv(F.substring(F.hex("class"), 1, 12), 16, 10).cast("long") % F.lit(FILTER_BITS)
    maps = wanted.select(bit().alias("at")).groupBy(F.call_function("div", F.col("at"), F.lit(32768)).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % F.lit(32768)).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    placed = texts.withColumn("at", bit()).withColumn("bucket", F.call_function("div", F.col("at"), F.lit(32768)))
    return placed.join(F.broadcast(maps), "bucket").where(F.expr("1") == F.call_function("getbit", byte, (F.col("at") % 8).cast("int")).cast("int")).drop("at", "bucket", "bits")


def shared_windows(documents: DataFrame, least: int = 240, text: str = "text") -> DataFrame:
    """What text classes share, as ``ref, ref_begin, class, begin, end, window``.

    Classes are those of :func:`text_classes`; exact copies are one and never compared. A row with
    ``ref`` tells that the characters from begin to end (exclusive) are those of the class ``ref`` from ref_begin on. A row
    with ``window`` names a window of ``least`` characters that no such row covers; classes with equal names have
    it in common, at least two. Two classes share a span of ``least`` characters if, and only if,
    they share such a window name or have rows on one reference that overlap there by as many,
    the reference itself having all of itself. A row of a reference on itself tells where it repeats a window. There are no pairs of classes in this, so that a passage that is in every
    text makes a row for each. Null and shorter texts have no rows.

    Each window of ``least`` characters has an anchor, the k-gram in it with the smallest hash;
    equal windows have equal anchors. Stretches around anchors that several texts have are cut out, and the
    anchors are taken again with longer k-grams within these. Each anchor that several texts still share gets a
    reference, the first text that has it. References are cut into shards by the anchors' places; the shard's
    stretches become a suffix automaton, a copy of it goes to each set of TEXTS_PER_COPY texts with the
    shard's anchors, and these stream through it for matching statistics. What two texts share
    beside the reference is found among the windows that it doesn't cover, by their names.

    Texts are shuffled once, those without shared anchors being left out before by a filter of
    fixed size.
    """
    k, fine, chars = least * 8 // 15, least * 13 // 15, CHARS_PER_PASS
    texts = documents.select(F.unhex(F.md5(F.col(text))).alias("class"), F.col(text).cast("string").alias("text")).where(F.length("text") >= least)
    rows = as_table(texts.withColumn("base", F.lit(0).cast("long")).mapInArrow(lambda it: _anchor_rows(it, least, k, chars), _ANCHORS), "span-anchors")
    none = [F.lit(None).cast("binary").alias("ref"), F.lit(None).cast("long").alias("shard")]
    places = _shared(rows).groupBy("class").agg(F.collect_set(F.struct(*none, "first", "last")).alias("places"))
    places = as_table(places, "span-places")
    found = _filtered(texts, places.select("class")).join(places, "class").select("class", "text", F.lit(0).cast("long").alias("begin"), "places")
    regions = found.mapInArrow(lambda it: _cut(it, least, k), _PIECES).dropDuplicates(["class", "begin"])
    regions = as_table(regions.select("class", "begin", "text"), "span-regions")
    close = regions.select("class", "text", "begin").mapInArrow(lambda it: _anchor_rows(it, least, fine, chars), _ANCHORS)
    close = as_table(close, "span-close")
    shared = close.groupBy("anchor").agg(F.min(F.struct("class", "first")).alias("lo"), F.max("class").alias("hi")).where("lo.class <> hi")
    shared = shared.select("anchor", F.col("lo.class").alias("ref"), F.call_function("div", F.col("lo.first"), F.lit(SHARD_CHARS)).alias("shard"))
    routed = close.join(shared, "anchor").groupBy("class").agg(F.collect_set(F.struct("ref", "shard", "first", "last")).alias("places"))
    pieces = regions.join(routed, "class").select("class", "text", "begin", "places").mapInArrow(lambda it: _cut(it, least, fine), _PIECES)
    pieces = as_table(pieces, "span-pieces")
    copies = pieces.where("class <> ref").groupBy("ref", "shard").agg(F.ceil(F.approx_count_distinct("class") / F.lit(TEXTS_PER_COPY)).alias("copies"))
    own = pieces.where("class = ref").join(copies, ["ref", "shard"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    others = pieces.where("class <> ref").join(copies, ["ref", "shard"]).withColumn("copy", F.pmod(F.xxhash64("class"), F.col("copies")))
    stream = own.unionByName(others).select("ref", "shard", "copy", "class", "begin", "text", (F.col("class") != F.col("ref")).alias("after"))
    stream = stream.repartition("ref", "shard", "copy").sortWithinPartitions("ref", "shard", "copy", "after", "class", "begin").drop("after")
    matches = as_table(stream.mapInArrow(lambda it: _match(it, least), _MATCHES_DDL), "span-matches")
    release(rows, places, regions, close, pieces)
    names = matches.where("window IS NOT NULL").groupBy("window").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("window")
    rest = matches.join(names, "window").select(*_MATCHES.names).distinct()
    return as_table(matches.where("ref IS NOT NULL").distinct().unionByName(rest), "span-shared")


def _class_pairs(shared: DataFrame, least: int) -> DataFrame:
    """``a, b``: the classes that share a span, a < b."""
    on = shared.where("ref <> class").select("ref", "class", F.col("ref_begin").alias("lo"), (F.col("ref_begin") + F.col("end") - F.col("begin")).alias("hi"))
    # An overlap of ``least`` characters holds a multiple of half as many.
    grid = F.sequence(F.call_function("div", F.col("lo") + (least // 2 - 1), F.lit(least // 2)), F.call_function("div", F.col("hi"), F.lit(least // 2)))
    cells = on.withColumn("cell", F.explode(grid))
    met = cells.alias("x").join(cells.alias("y"), ["ref", "cell"]).where("x.class < y.class AND least(x.hi, y.hi) - greatest(x.lo, y.lo) >= " + str(least))
    with_ref = on.select(F.least("ref", "class").alias("a"), F.greatest("ref", "class").alias("b"))
    names = shared.where("window IS NOT NULL").select("window", "class").distinct()
    by_name = names.alias("x").join(names.alias("y"), "window").where("x.class < y.class")
    pick = [F.col("x.class").alias("a"), F.col("y.class").alias("b")]
    return met.select(*pick).unionByName(with_ref).unionByName(by_name.select(*pick)).distinct()


def sharing_pairs(documents: DataFrame, least: int = 240) -> DataFrame:
    """``doc_a, doc_b`` (doc_a < doc_b) of all documents that share a run of at least ``least`` characters.

    What classes share comes from :func:`shared_windows`; only here are classes paired, then the members of both,
    and the copies within a class, as the result asks for every pair of documents.
    """
    members = text_classes(documents, least)
    classes = _class_pairs(shared_windows(documents, least), least)
    across = (
        classes.join(members.select(F.col("class").alias("a"), F.col("doc_id").alias("m")), "a")
        .join(members.select(F.col("class").alias("b"), F.col("doc_id").alias("n")), "b")
        .select(F.least("m", "n").alias("doc_a"), F.greatest("m", "n").alias("doc_b"))
    )
    within = members.select("class", F.col("doc_id").alias("doc_a")).join(members.select("class", F.col("doc_id").alias("doc_b")), "class").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within).where("doc_a <> doc_b").distinct()


def _joined(runs: DataFrame, least: int) -> DataFrame:
    """``class, begin, end``: runs made one where the next one's first window begins at most one after the last window before it."""
    order = Window.partitionBy("class").orderBy("begin")
    each = runs.groupBy("class", "begin").agg(F.max("end").alias("end"))  # at most as many as the text has characters
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("_new", F.coalesce(F.col("begin") > upto - least + 1, F.lit(True)).cast("int"))
    return marked.withColumn("_n", F.sum("_new").over(order)).groupBy("class", "_n").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_n")


def document_spans(documents: DataFrame, least: int = 240, text: str = "text") -> DataFrame:
    """``doc_id, begin, end``: the maximal stretches of each document all of whose windows of ``least`` characters recur in others.

    Offsets count code points, ``end`` is exclusive. Stretches may overlap by less than ``least``, where
    no window over the overlap recurs. A document with a copy is one stretch.
    """
    members = text_classes(documents, least)
    shared = shared_windows(documents, least, text)
    length = F.col("end") - F.col("begin")
    other = F.coalesce(F.col("ref") != F.col("class"), F.lit(True))
    on_ref = shared.where("ref <> class").select(F.col("ref").alias("class"), F.col("ref_begin").alias("begin"), (F.col("ref_begin") + length).alias("end"))
    runs = _joined(shared.where(other).select("class", "begin", "end").unionByName(on_ref), least)
    again = shared.where("ref = class").select("class", F.col("ref_begin").alias("at"), (F.col("ref_begin") + length).alias("upto"), F.col("begin").alias("_b"))
    again = again.join(runs, "class").where(F.least("end", "upto") - F.greatest("begin", "at") >= least)
    moved = F.col("_b") - F.col("at")
    again = again.select("class", (F.greatest("begin", "at") + moved).alias("begin"), (F.least("end", "upto") + moved).alias("end"))
    per_class = _joined(runs.unionByName(again), least)
    copied = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    lengths = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("class"), F.length(text).cast("long").alias("end"))
    whole = lengths.where("doc_id IS NOT NULL").distinct().join(copied, "class").select("doc_id", F.lit(0).cast("long").alias("begin"), "end")
    return members.join(copied, "class", "left_anti").join(per_class, "class").select("doc_id", "begin", "end").unionByName(whole.where(F.col("end") >= least)).distinct()


def shared_amounts(documents: DataFrame, least: int = 240, text: str = "text") -> DataFrame:
    """``doc_id, n_chars, stretches, shared_chars``, a row for each document that shares a span.

    ``stretches`` counts those of :func:`document_spans`, ``shared_chars`` the characters within
    them; all of the document's where there is a copy. Of several texts under one id each counts by itself, the greatest values come out.
    """
    covered = F.expr("aggregate(spans, struct(0L AS n, 0L AS upto), (a, s) -> struct(a.n + greatest(0L, s.end - greatest(s.begin, a.upto)) AS n, greatest(a.upto, s.end) AS upto), a -> a.n)")
    spans = document_spans(documents, least, text).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    lengths = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    return spans.join(lengths, "doc_id").select("doc_id", "n_chars", F.size("spans").cast("long").alias("stretches"), covered.alias("shared_chars"))


def without_shared_spans(documents: DataFrame, least: int = 240, text: str = "text") -> DataFrame:
    """``doc_id, text`` of all documents with an id, the stretches of :func:`document_spans` removed.

    A passage is removed wherever it stands, also from the document that has it first. A null text stays null.
    """
    spans = document_spans(documents, least, text).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    kept = F.expr("""aggregate(spans, struct('' AS kept, 0L AS upto), (a, s) -> struct(concat(a.kept, IF(s.begin > a.upto, substring(text, cast(a.upto + 1 AS int), cast(s.begin - a.upto AS int)), '')) AS kept, greatest(a.upto, s.end) AS upto),
        a -> concat(a.kept, substring(text, cast(a.upto + 1 AS int))))""")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.join(spans, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"))
