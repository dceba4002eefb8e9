import math
import random

import pytest
from pyspark.sql import functions as F

from spandrel.operators import intervals as I

DDL = "clip_id string, seg_idx int, start_ms double, end_ms double, slice string, starts int"
KEYS = ["clip_id", "seg_idx"]


def brute(rows):
    """Periods and gaps of each key by a sorted sweep."""
    by = {}
    for c, s, a, b, *_ in rows:
        if a is None or b is None or math.isnan(a) or math.isnan(b) or math.isinf(a) or math.isinf(b) or not b > a:
            continue
        by.setdefault((c, s), []).append((round(a * 1000), round(b * 1000)))
    periods, gaps = [], []
    for k, v in by.items():
        v.sort()
        lo, hi = v[0]
        for a, b in v[1:]:
            if a > hi:
                periods.append((*k, lo, hi))
                gaps.append((*k, hi, a))
                lo = a
                hi = b
            hi = max(hi, b)
        periods.append((*k, lo, hi))
    return sorted(periods, key=str), sorted(gaps, key=str)


def made(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = round(r.uniform(-500, 3000), 3)
        b = a + r.choice([0.0, -1.0, 0.001, 5.0, 40.0, 300.0])
        a, b = r.choice([(a, b)] * 12 + [(None, b), (a, None), (math.nan, b), (a, math.nan), (a, math.inf)])
        out.append((r.choice(["a"] * 8 + ["b", None]), r.choice([0, 0, 0, 1, None]), a, b, "x", 1))
    return out + out[:40]


@pytest.mark.parametrize("seed,slice_us", [(1, 1 << 26), (2, 1000), (3, 50_000), (4, 7)])
def test_against_brute_force(spark, rows, seed, slice_us):
    data = made(seed)
    df = spark.createDataFrame(data, DDL).repartition(5)
    st = I.interval_states(df, KEYS, F.col("start_ms"), F.col("end_ms"), slice_us)
    periods, gaps = brute(data)
    assert rows(I.covered_periods(st, KEYS)) == periods
    assert rows(I.interval_gaps(st, KEYS)) == gaps
    assert rows(I.interval_gaps(st, KEYS, 20_000)) == [g for g in gaps if g[3] - g[2] >= 20_000]


def test_states_of_loads_combine(spark, rows):
    data = made(7)
    halves = [I.interval_states(spark.createDataFrame(p, DDL), KEYS, F.col("start_ms"), F.col("end_ms")) for p in (data[::2], data[1::2])]
    whole = I.combine_states(halves[0].unionByName(halves[1]), KEYS)
    assert rows(I.covered_periods(whole, KEYS)) == brute(data)[0]


def test_empty_and_hot_key(spark, rows):
    st = I.interval_states(spark.createDataFrame([], DDL), KEYS, F.col("start_ms"), F.col("end_ms"))
    assert rows(I.interval_gaps(st, KEYS)) == [] and rows(I.covered_periods(st, KEYS)) == []
    hot = spark.range(20_000).select(F.lit("h").alias("clip_id"), F.lit(1).alias("seg_idx"), (F.col("id") * 2.0).alias("start_ms"), (F.col("id") * 2.0 + 1).alias("end_ms"))
    st = I.interval_states(hot, KEYS, F.col("start_ms"), F.col("end_ms"), 1_000_000)
    assert I.interval_gaps(st, KEYS, 1000).count() == 19_999
