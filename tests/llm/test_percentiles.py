import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import percentiles as P

AT = {"p01": 0.01, "median": 0.5, "p99": 0.99}


@pytest.mark.parametrize("seed,k,ties", [(1, 16, False), (2, 64, True), (3, 7, True), (4, 4096, False)])
def test_rank_error_is_bounded(seed, k, ties):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=20_000)
    x = np.round(x, 1) if ties else x
    parts = [P.Sketch(k) for _ in range(9)]
    for s, v in zip(parts, np.array_split(x, 9)):
        for w in np.array_split(v, 7):
            s.add(w)
    whole = P.Sketch(k)
    for s in parts:
        whole.merge(s.n, s.err, s.buffers())
    assert whole.n == len(x)
    assert sum(w * len(v) for w, v in whole.buffers()) == len(x)
    assert whole.err <= len(x) * math.log2(max(2, len(x) / k)) / (2 * k)
    order = np.sort(x)
    for q in (0.001, 0.1, 0.5, 0.9, 1.0):
        v = whole.quantiles([q])[0]
        rank = max(1, math.ceil(q * len(x) - 1e-9))
        lo, hi = np.searchsorted(order, v, "left") + 1, np.searchsorted(order, v, "right")
        assert lo - whole.err <= rank <= hi + whole.err
    if k >= len(x):
        assert whole.err == 0


def test_days_combine(spark):
    rng = np.random.default_rng(5)
    data = [(g, int(d), float(v)) for g in ("a", None) for d in range(4) for v in np.round(rng.random(500), 2)]
    data += [("a", 1, None), ("a", 1, math.nan), ("a", 2, 7.0), ("a", 2, -0.1), ("only-bad", 1, None)]
    df = spark.createDataFrame([(*r, 0) for r in data], "label string, day int, v double, n int").repartition(6)
    daily = P.sketches(df, ["label", "day"], F.col("v"), 0.0, 1.0)
    got = {r.label: r for r in P.percentiles(P.merge_sketches(daily, ["label"]), ["label"], AT).collect()}
    assert set(got) == {"a", None}
    for g in ("a", None):
        own = sorted(v for lab, _, v in data if lab == g and v is not None and 0 <= v <= 1)
        assert got[g].n == len(own) and got[g].rank_error == 0
        assert [got[g].p01, got[g].median, got[g].p99] == [own[math.ceil(q * len(own) - 1e-9) - 1] for q in AT.values()]
    assert daily.count() == 8


def test_small_buffers_in_spark(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") / n).alias("v")).repartition(8)
    r = P.percentiles(P.sketches(df, ["g"], F.col("v"), k=128), ["g"], AT, 128).first()
    assert r.n == n and abs(r.median - 0.5) * n <= r.rank_error + 1
    assert P.sketches(df.limit(0), ["g"], F.col("v")).count() == 0


def test_order_of_arrival_does_not_matter(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("a", float(v)) for v in rng.random(20_000)], "g string, v double").repartition(12)
    parts = P.map_arrow(df.select("g", "v"), P._partial(1, 64), "g STRING, " + P._STATE)
    kept = parts.collect()
    assert len(kept) > 6
    seen = set()
    for seed in range(4):
        rng.shuffle(order := list(range(len(kept))))
        again = spark.createDataFrame([kept[i] for i in order], parts.schema).repartition(1 + seed)
        seen.add(tuple(P.percentiles(P.merge_sketches(again, ["g"], 64, fan_in=3), ["g"], AT, 64).first()))
    assert len(seen) == 1
