import random

import numpy as np
import pytest

from memlode.llm.split import HEADING, LINE, PARAGRAPH, RangeMax, SENTENCE, boundaries, split_oversized, split_text


def rebuilt(data, pieces):
    out, done = b"", 0
    for a, b in pieces:
        assert a <= done < b or not data
        out += data[max(a, done):b]
        done = b
    return out


def test_range_max_against_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5, 97)
    table = RangeMax(v)
    for lo in range(97):
        for hi in range(lo + 1, 98):
            part = v[lo:hi]
            assert table.argmax(lo, hi) == lo + np.flatnonzero(part == part.max())[-1]


def test_strengths():
    text = "One. Two\nthree\n\nfour\r\n# five"
    s = boundaries(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
    assert s[text.index("Two")] == SENTENCE
    assert s[text.index("three")] == LINE
    assert s[text.index("four")] == PARAGRAPH
    assert s[text.index("# five")] == HEADING
    assert s[text.index("\r\n") + 1] == 0


@pytest.mark.parametrize("limit,overlap", [(40, 0), (40, 10), (64, 50), (64, 63), (4, 3), (100, -5), (1, 0)])
def test_round_trip_and_limits(limit, overlap):
    rng = random.Random(limit * 7 + overlap)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "語", "😀", " ", "\n", "\n\n", ". ", "\r\n", "é", "x" * 30]) for _ in range(rng.randint(0, 120)))
        data = text.encode()
        pieces = split_text(text, limit, overlap)
        assert rebuilt(data, pieces) == data
        for a, b in pieces:
            assert b - a <= max(4, limit)
            data[a:b].decode()


def test_cut_is_the_strongest_boundary():
    text = "a" * 30 + " b. " + "c" * 10 + "\n\n" + "d " * 20
    first = split_text(text, 60, 0)[0]
    assert text.encode()[: first[1]].endswith(b"\n\n")


def test_overlap_is_about_as_asked():
    text = " ".join(f"word{i}" for i in range(2000))
    pieces = split_text(text, 1000, 100)
    for (_, b), (c, _) in zip(pieces, pieces[1:]):
        assert 50 <= b - c <= 150


@pytest.mark.parametrize("asked", [300, 600, 900])
def test_large_overlaps_are_kept(asked):
    text = " ".join(f"word{i}" for i in range(2000))
    pieces = split_text(text, 1000, asked)
    assert rebuilt(text.encode(), pieces) == text.encode()
    for (_, b), (c, _) in zip(pieces, pieces[1:]):
        assert abs(b - c - asked) <= 20
    with pytest.raises(ValueError):
        split_text(text, 1000, 1000)


def test_operator_on_odd_rows(spark):
    rows = [("1", "h", "x" * 50, "prose", 7), ("2", None, None, "prose", 7), ("3", "", "", "prose", 7), ("4", "h", "x" * 50, None, 7), ("5", "h", "é" * 40, "prose", 7), ("6", "h", "x" * 500, "unlimited", 7)]
    items = spark.createDataFrame(rows, "id string, label string, content string, content_type string, max_bytes int")
    limits = spark.createDataFrame([("prose", 20, 4)], "content_type string, max_bytes int, overlap_bytes int")
    out = split_oversized(items, limits).collect()
    assert {r.id for r in out} == {"1", "5"}
    assert all(len(r.piece.encode()) <= 20 and r.label == "h" for r in out)
    assert split_oversized(items.limit(0), limits).count() == 0
