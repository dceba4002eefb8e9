import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import splitting as S


def test_range_maximum_against_brute_force():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 300).astype(np.int8)
    t = S.StrongestCut(x, 64)
    for _ in range(500):
        lo = int(rng.integers(0, 299))
        hi = min(299, lo + int(rng.integers(0, 64)))
        best = max(range(lo, hi + 1), key=lambda i: (x[i], i))
        assert t.best(lo, hi) == (best, int(x[best]))


def made(r, n):
    words = ["a", "bc,", "défg.", "hi!", "jklmno", "x" * r.choice([1, 5, 400]), "(pqr.)", "st;"]
    out = ""
    while len(out) < n:
        out += r.choice(words) + " "
    return out[:n]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_keep_limits_and_lose_nothing(seed):
    r = random.Random(seed)
    text = made(r, r.choice([301, 350, 900, 5000]))
    dur = r.choice([None, 10.0, 31.0, 95.0, 3000.0])
    pieces = S.pieces_of(text, 5.0 if dur else None, 5.0 + dur if dur else None, 300, 30.0, 40)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, s, e), (c, d, *_) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= 40
    for a, b, s, e in pieces:
        assert b - a <= 300
        assert dur is None or e - s <= 30 + 1e-9
    assert "".join(text[max(a, p):b] for (a, b, *_), p in zip(pieces, [0, *(b for _, b, *_ in pieces)])) == text


def test_cuts_at_the_strongest_place():
    text = "word " * 40 + "end. " + "word " * 30
    (a, b), (c, d) = S.cut_points(text, 300, 40)
    assert text[:b].endswith("end.") and 0 < b - c <= 40 and text[c - 1] == " "


def test_edges():
    assert S.pieces_of(None, 0.0, 90.0, 300, 30.0, 40) == [(0, 0, 0.0, 30.0), (0, 0, 30.0, 60.0), (0, 0, 60.0, 90.0)]
    assert S.pieces_of("", None, None, 300, 30.0, 40) == [(0, 0, None, None)]
    assert S.pieces_of("abc", 0.0, 300.0, 300, 30.0, 40)[-1][3] == 300.0
    assert len(S.pieces_of("x" * 1000, math.nan, 3.0, 300, 30.0, 40)) >= 4
    assert S.pieces_of("x" * 300, 9.0, 3.0, 300, 30.0, 40) == [(0, 300, None, None)]


def test_operator(spark, rows):
    ddl = "seg_uid bigint, text string, s double, e double, piece string, oversized int"
    data = [(1, "x" * 301, 0.0, 1.0), (2, "x" * 300, 0.0, 30.0), (3, None, 0.0, 30.5), (4, "a", math.nan, 99.0), (5, None, None, None), (6, "a", 0.0, math.inf), (7, "😀" * 301, None, 1.0), (1, "x" * 301, 0.0, 1.0)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in data], ddl)
    out = S.split_oversized(df, "seg_uid", "text", F.col("s"), F.col("e"))
    assert [r.seg_uid for r in out.where("oversized AND piece = 0").orderBy("seg_uid").collect()] == [1, 1, 3, 6, 7]
    assert out.where("seg_uid = 7 AND char_end - char_start > 300").count() == 0
    assert S.split_oversized(df.limit(0), "seg_uid", "text", F.col("s"), F.col("e")).count() == 0


def test_very_long_text():
    text = "some words here. " * 60_000
    pieces = S.cut_points(text, 300, 40)
    assert pieces[-1][1] == len(text) and max(b - a for a, b in pieces) <= 300


@pytest.mark.parametrize("text", ["\u4e2d\u6587" * 400, "\u0e44\u0e17\u0e22" * 300, "x" * 1000])
def test_overlap_without_spaces(text):
    pieces = S.pieces_of(text, None, None, 300, 30.0, 40)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= 300 for a, b, *_ in pieces)
    assert all(p[1] - q[0] == 40 for p, q in zip(pieces, pieces[1:]))
