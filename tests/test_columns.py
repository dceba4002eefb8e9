import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.functions import columns as C
from spandrel.operators import decoding as D
from spandrel.operators import signal as S


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(v for _, v in values.values())], ", ".join(f"{k} {t}" for k, (t, _) in values.items()))
    return df.select(c.alias("x")).first().x


def test_run_lengths_golden(spark):
    x = ("array<int>", [0, 0, 0, 1, 1, 3, 4, 2, 2, 2])
    got = one(spark, C.run_lengths(F.col("x")), x=x)
    assert [tuple(r) for r in got] == [(0, 3), (1, 2), (3, 1), (4, 1), (2, 3)]
    assert one(spark, C.expanded(C.run_lengths(F.col("x"))), x=x) == x[1]
    assert one(spark, C.run_lengths(F.col("x")), x=("array<int>", [])) == []


def test_frame_counts_golden(spark):
    n = lambda v: one(spark, C.frame_count(F.col("n"), 1920, 1280, 10), n=("bigint", v))
    assert n(160_000) == 620 and n(20_141) == 75 and n(1920) == 10 and n(100) is None
    assert one(spark, C.layer_size(F.col("n"), [(15, 7, 7), (11, 5, 5), (7, 3, 3), (5, 2, 2)]), n=("bigint", 1920)) == 10
    assert one(spark, F.size(C.windows(F.array_repeat(F.lit(0.0), 160_000), 1920, 1280)), n=("int", 1)) == 124


@pytest.mark.parametrize("frame,ms", [(3, 50.352497), (7, 117.489166), (9, 151.057495), (18, 302.114990), (66, 1107.755005)])
def test_frame_ms_golden(spark, frame, ms):
    assert abs(one(spark, C.frame_ms(F.col("f"), F.lit(20_141), F.lit(75)), f=("int", frame)) - ms) < 1e-3


def test_softmax_boost_floor(spark):
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=9) * 30, np.array([2, 5, 8])
    lp = one(spark, C.log_softmax(F.col("x")), x=("array<double>", x.tolist()))
    assert np.allclose(lp, D.log_softmax(x))
    b = one(spark, C.floored(C.boosted(C.log_softmax(F.col("x")), F.col("t"), 5.0, 8), F.col("t"), 8), x=("array<double>", x.tolist()), t=("array<int>", t.tolist()))
    assert np.allclose(b, D.floored(D.boosted(D.log_softmax(x)[None], t, 5.0, 8), t, 8)[0])


def test_small_ones(spark):
    code = lambda a, b, n: one(spark, C.chop_code(F.lit(a), F.lit(b), F.lit(n)), z=("int", 1))
    assert code(0.0, 100 / 16000, 50_000) == -1 and code(1.0, 2.0, 16_100) == -2 and code(0.0, 1.0, 16_000) == 0
    assert np.allclose(one(spark, C.rms_normalised(F.col("x")), x=("array<double>", [3.0, 4.0])), np.array([3, 4]) / np.sqrt(12.5))
    assert one(spark, C.rms_normalised(F.col("x")), x=("array<double>", [0.0, 0.0])) == [0.0, 0.0]
    assert one(spark, C.down_mixed(F.col("x"), F.col("y")), x=("array<double>", [1.0]), y=("array<double>", [3.0])) == [2.0]
    assert one(spark, C.ctc_path(F.col("t"), F.lit(2), 66), t=("array<int>", [5, 6])) == [66, 5, 66, 6, 66]
    assert abs(one(spark, C.decompressed(C.compressed(F.col("v"))), v=("double", 3.5)) - 3.5) < 1e-12
    c = one(spark, C.coverage(F.col("t"), F.col("a")), t=("array<int>", [1, 1, 2, 3]), a=("array<int>", [2, 3, 9]))
    assert (c.target_count, c.missing_count, c.extra_count, c.bad_alignment) == (3, 1, 1, True)
    assert one(spark, C.coverage(F.col("t"), F.col("a")), t=("array<int>", []), a=("array<int>", [])).coverage_ratio == 1.0


def test_mel_and_resample():
    m = S.mel_spectrum(np.sin(np.arange(22_050) * 0.1))
    assert m.shape[1] == 80 and abs(m.shape[0] - 22_050 // 256) <= 1 and np.isfinite(m).all()
    assert S.mel_spectrum(np.zeros(3)).shape == (0, 80)
    assert len(S.resampled(np.arange(100.0), 8000, 16_000)) == 200 and np.allclose(S.resampled(np.arange(10.0), 2, 4)[:5], [0, 0.5, 1, 1.5, 2])
