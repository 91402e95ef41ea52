import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.llm import spans
from mnemoframe.llm.spans import SuffixAutomaton, document_spans, shared_amounts, sharing_pairs, without_shared_spans


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=3), st.text("abc", max_size=18), st.integers(1, 4))
def test_windows_of_a_text_and_where_they_occur_first(reference, text, width):
    joined, first, at = "".join(reference), {}, 0
    for r in reference:
        for i in range(len(r) - width + 1):
            first.setdefault(r[i : i + width], at + i)
        at += len(r)
    got = {}
    for begin, end, place in SuffixAutomaton(reference).windows(text, width):
        for i in range(end - begin - width + 1):
            assert begin + i not in got
            got[begin + i] = place + i
            assert joined[place + i : place + i + width] == text[begin + i : begin + i + width]
    assert got == {i: first[text[i : i + width]] for i in range(len(text) - width + 1) if text[i : i + width] in first}


def corpus():
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefgh \r\né") for _ in range(n))
    common, boiler = word(60), word(45)
    docs = [(i, word(draw.randint(0, 300))) for i in range(40)]
    docs += [(100, word(80) + common + word(50)), (101, common + word(200)), (102, word(10) + common[5:50] + word(10))]
    docs += [(110 + i, word(30) + boiler + word(30)) for i in range(6)] + [(120 + i, docs[3][1] + "tail" * 12) for i in range(3)]
    docs += [(130, "-" * 500), (131, "x" + "-" * 300), (132, None), (133, ""), (134, common), (135, "ab" * 400), (136, "ba" * 90), (137, common[:39])]
    docs.append((100, docs[40][1]))
    return docs


def brute(docs, least):
    grams = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            grams[t[i : i + least]].add(d)
    pairs = {(a, b) for s in grams.values() for a in s for b in s if a < b}
    amounts = {}
    for d, t in dict(docs).items():
        covered = {x for i in range(len(t or "") - least + 1) if len(grams[t[i : i + least]]) > 1 for x in range(i, i + least)}
        if covered:
            amounts[d] = len(covered)
    return pairs, amounts


def stretches(docs, least):
    grams = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            grams[t[i : i + least]].add(d)
    out = set()
    for d, t in dict(docs).items():
        starts = [i for i in range(len(t or "") - least + 1) if len(grams[t[i : i + least]]) > 1]
        for i in starts:
            if i - 1 not in starts:
                j = i
                while j + 1 in starts:
                    j += 1
                out.add((d, i, j + least))
    return out


@pytest.mark.parametrize("settings_", [{}, {"CHARS_PER_PASS": 64, "TEXTS_PER_COPY": 2, "SHARD_CHARS": 30, "FILTER_BITS": 32768}])
def test_pairs_and_amounts_equal_brute_force(spark, monkeypatch, settings_):
    for name, value in settings_.items():
        monkeypatch.setattr(spans, name, value)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, amounts = brute(docs, 40)
    got = [tuple(r) for r in sharing_pairs(df, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    rows = shared_amounts(df, 40).collect()
    assert {r["doc_id"]: r["shared_chars"] for r in rows} == amounts
    found = [tuple(r) for r in document_spans(df, 40).collect()]
    assert len(found) == len(set(found)) and set(found) == stretches(docs, 40)
    covered = {d: {x for e, i, j in found if e == d for x in range(i, j)} for d, _ in docs}
    left = {r["doc_id"]: r["text"] for r in without_shared_spans(df.distinct(), 40).collect()}
    assert left == {d: t if t is None else "".join(c for x, c in enumerate(t) if x not in covered[d]) for d, t in docs}


def test_a_passage_in_every_text_makes_a_row_a_text(spark):
    draw = random.Random(2)
    word = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9E00)) for _ in range(n))
    common = word(60)
    for n in (50, 200):
        df = spark.createDataFrame([(i, word(80) + chr(0x400 + i) + common + chr(0x600 + i) + word(80)) for i in range(n)], "doc_id long, text string")
        assert spans.shared_windows(df, 40).count() == n - 1
        assert {(r["stretches"], r["shared_chars"]) for r in shared_amounts(df, 40).collect()} == {(1, 60)}
    assert sharing_pairs(df, 40).count() == n * (n - 1) // 2


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharing_pairs(df, 40).collect() == [] and shared_amounts(df, 40).collect() == []
