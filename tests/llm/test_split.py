import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrywork.llm import p5_split as P


def test_range_maximum_against_scan():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 100):
        v = np.array([rng.randint(0, 4) for _ in range(n)], dtype=np.int8)
        index = P.RangeMaximum(v)
        for _ in range(200):
            low = rng.randrange(n)
            high = rng.randrange(low, n)
            best = max(range(low, high + 1), key=lambda i: (v[i], i))
            assert index.query(low, high) == (best, v[best])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!?é,", max_size=600), st.integers(5, 20), st.integers(0, 3))
def test_pieces_fit_overlap_and_rebuild(text, limit, overlap):
    parts = P.split_text(text, limit, overlap)
    assert all((e - s) // P.UNIT <= limit for s, e, _ in parts)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    if len(parts) > 1:
        assert all(a[1] - b[0] == overlap * P.UNIT for a, b in zip(parts, parts[1:], strict=False))
    rebuilt = text[: parts[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(parts, parts[1:], strict=False))
    assert rebuilt == text


def test_strongest_rightmost_cut():
    text = "aaaa. bbbb.\n\ncccc. dddd. eeee ffff gggg"
    s, e, strength = P.split_text(text, 6, 0)[0]
    assert text[:e] == "aaaa. bbbb.\n\n" and strength == P.PARAGRAPH
    with pytest.raises(ValueError):
        P.split_text("x" * 100, 5, 9)


def test_cut_kinds():
    assert P.cut_kind("a" * 40 + "\n\n" + "b" * 40, 10) == "paragraph"
    assert P.cut_kind("a" * 39 + ". " + "b" * 40, 10) == "sentence"
    assert P.cut_kind("a" * 40 + "\n" + "b" * 40, 10) == "sentence"
    assert P.cut_kind("a b " * 40, 10) == "none"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n!?é \t", max_size=300), st.integers(1, 12))
def test_cut_kinds_against_splitting(text, limit):
    fits = lambda parts: all(len(p) // P.UNIT <= limit for p in parts)
    by_sentence = [p for line in text.split("\n") for p in P._SENTENCE.split(line)]
    want = "paragraph" if fits(P._PARAGRAPH.split(text)) else "sentence" if fits(by_sentence) else "none"
    assert P.cut_kind(text, limit) == want


def test_table_cases(spark):
    rows = [("a", None, None, "t", 1), ("b", "", "child", None, 1), ("c", "x " * 1000, "child", "t", 1), ("d", "y" * 3300, "parent", "t", 1), ("c", "x " * 1000, "child", "t", 1), ("e", "é" * 1003, None, "t", 1), ("f", "z" * 200_000, "child", "t", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, level string, section_title string, piece int")
    got = P.split_oversized(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert "a" not in by and [r.text for r in by["b"]] == [""] and len(by["e"]) == 1 and by["e"][0].cut_kind is None
    assert len(by["c"]) % 2 == 0 and all(r.section_title == "t" for r in by["c"])
    assert {r.cut_kind for r in by["d"]} == {"none"} and max(len(r.text) // 4 for r in by["d"]) <= 800
    assert len(by["f"]) > 200
    assert sorted((r.chunk_id, r.cut_kind) for r in P.found(df).collect()) == [("c", "none"), ("d", "none"), ("f", "none")]
    assert P.found(df.limit(0)).count() == 0
