"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of Unicode letters and digits.
WORDS = re.compile(r"[^\W_]+")
#: So many consecutive words of an item make a leak; an item with fewer must occur whole.
LEAK_WORDS = 12
#: Characters of test items that go into one set of tables, which then take some 100 MB of a worker; more items make more passes.
PATTERN_CHARS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class WuManber:
    """Wu-Manber search for many word sequences at once.

    Symbols are words and a block is two of them (one, where a pattern has a single word). The
    shift table has for each block how far the window may move on at least; a block that no
    pattern holds lets it pass by as a whole. Where the shift is zero, the bucket of the
    window's last block has the patterns by their first block, and these are compared word by
    word.
    """

    def __init__(self, patterns: Iterable[tuple[Sequence[str], int]]) -> None:
        merged: dict[tuple[str, ...], set[int]] = {}
        for words, owner in patterns:
            if words:
                merged.setdefault(tuple(words), set()).add(owner)
        self.window = min(map(len, merged), default=0)
        self.block = min(2, self.window)
        self.farthest = self.window - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple[tuple[str, ...], frozenset[int]]]]] = {}
        for words, owners in merged.items():
            for end in range(self.block, self.window + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.farthest), self.window - end)
            last = words[self.window - self.block : self.window]
            self.bucket.setdefault(last, {}).setdefault(words[: self.block], []).append((words, frozenset(owners)))

    def owners_in(self, words: list[str]) -> set[int]:
        """Owners of the patterns that occur in the text."""
        found: set[int] = set()
        window, block, farthest, shift = self.window, self.block, self.farthest, self.shift
        if not window:
            return found
        end, last = window, len(words)
        while end <= last:
            key = tuple(words[end - block : end])
            move = shift.get(key, farthest)
            if move:
                end += move
                continue
            start = end - window
            for pattern, owners in self.bucket[key].get(tuple(words[start : start + block]), ()):
                if not owners <= found and tuple(words[start : start + len(pattern)]) == pattern:
                    found |= owners
            end += 1
        return found


def item_patterns(items: Iterable[tuple[int, str | None]], leak_words: int = LEAK_WORDS) -> list[tuple[list[str], int]]:
    """Each window of ``leak_words`` words of each item; an item with fewer words as a whole."""
    patterns = []
    for item_id, text in items:
        words = words_of(text)
        patterns += [(words[i : i + leak_words], item_id) for i in range(max(1, len(words) - leak_words + 1)) if words]
    return patterns


def _search(batches: Iterator[pa.RecordBatch], matchers: list[WuManber], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, found = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            hits = set().union(*(m.owners_in(words) for m in matchers)) if words else ()
            docs += [doc_id] * len(hits)
            found += hits
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], schema=schema)


def leaked_items(documents: DataFrame, items: DataFrame, leak_words: int = LEAK_WORDS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id`` for each document that holds a passage of a test item; distinct rows.

    A passage is ``leak_words`` consecutive words of the item in a row, or all words of an item
    that has fewer. Words are runs of Unicode letters and digits, lower-cased. Items and
    documents without words never match, rows with a null id don't count.

    The items' tables go to the workers as long as the items have at most PATTERN_CHARS
    characters. Larger sets are searched for in several passes of that size. Documents are streamed whole and
    aren't shuffled; only hits are.
    """
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    corpus = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // PATTERN_CHARS))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    found = None
    for k in range(passes):
        block = [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).toLocalIterator()]
        patterns = item_patterns(block, leak_words)
        whole = [p for p in patterns if len(p[0]) == leak_words]
        short = [p for p in patterns if len(p[0]) < leak_words]
        shared = corpus.sparkSession.sparkContext.broadcast([WuManber(p) for p in (whole, short) if p])
        part = corpus.mapInArrow(lambda it, shared=shared: _search(it, shared.value, schema), "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
