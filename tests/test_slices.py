"""Sliced scans against plain computations, with slices so small that everything crosses their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.operators import decoding, islands, raster


@pytest.mark.parametrize("slice_rows", [4, 7, 1000])
def test_silences_in_slices(spark, slice_rows):
    rng = np.random.default_rng(slice_rows)
    data, want = [], set()
    for key in range(6):
        p = np.round((rng.random(60) > 0.4) * rng.random(60) ** 0.2, 3) if key else np.ones(60)
        data += [(key if key else None, i, float(x)) for i, x in enumerate(p)]
        for step, (k, t) in enumerate(((5, 0.6), (3, 0.7))):
            want |= {(key if key else None, step, a, b) for a, b in decoding.silent_stretches(np.log(np.maximum(p, 1e-30))[:, None], 0, k, t)}
    df = spark.createDataFrame(data, "k int, i int, p double")
    rules = {0: (5, 0.6, None), 1: (3, 0.7, F.lit(True))}
    got = [tuple(r) for r in islands.silent_runs(df.where("k IS NOT NULL"), ["k"], "i", F.col("p"), rules, slice_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[0] is not None}
    one = df.where("k IS NULL").withColumn("k", F.lit(0))
    assert [tuple(r) for r in islands.silences(one, ["k"], "i", F.col("p"), 5, 0.6, slice_rows).collect()] == [(0, 0, 60)]


def test_raster_in_slices(spark, monkeypatch):
    monkeypatch.setattr(raster, "SLICE", 4)
    monkeypatch.setattr(raster, "PIECE_MS", 70.0)
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(3)), i, float(s := np.round(rng.random() * 1500, 1)), float(s + np.round(rng.random() ** 3 * 300 + 1, 1)), i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, id int, s double, e double, label int")
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        first, end = own[0][2], max(r[3] for r in own)
        for _, _, s, e, label in own:
            for f in range(max(0, int((s - first) // 20) - 1), min(int(np.ceil((e - first) / 20)) + 1, int(np.ceil((end - first) / 20)))):
                want.setdefault((k, f), label)
    made = raster.rasterised(df, ["k"], F.col("s"), F.col("e"), F.col("label"), ["id"], 20.0)
    got = [((r.k, r.frame), r.label) for r in made.collect()]
    assert len(got) == len(want) and dict(got) == want
    filled = {}
    for k in {x for x, _ in want}:
        at = sorted(f for x, f in want if x == k)
        for a, b in zip(at, at[1:]):
            n = b - a - 1
            for i in range(1, n + 1):
                left = n <= 2 or (i <= n // 2 if n <= 4 else i <= 2)
                right = not left if n <= 4 else i > n - 2
                if left or right:
                    filled[k, a + i] = want[k, a if left else b]
    assert {((r.k, r.frame), r.label) for r in raster.closed(made, ["k"], 2).collect()} == set((want | filled).items())
