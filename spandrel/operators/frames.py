"""Frames in long form: overlap-add, scores and weighted pooling by grouping, without Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import columns as C


def window_weights(frames: int) -> list[float]:
    """Cosine weights of a window's frames in single precision, so that the outermost frames keep their value."""
    return [float(w) for w in np.cos(np.linspace(-np.pi / 2, np.pi / 2, frames, dtype=np.float32)).astype(np.float32)]


def overlap_added(df: DataFrame, keys: list[str], window: str, frames: Column, per_window: int) -> DataFrame:
    """keys, t, cls, value: overlapping windows of per_window frames, half a window apart, as one sequence.

    frames: ARRAY<ARRAY<DOUBLE>> of a window.  What reaches beyond the last half window is cut off.
    """
    half = per_window // 2
    n = df.groupBy(*keys).agg((F.max(window) + 1).alias("_windows"))
    weights = F.array(*map(F.lit, window_weights(per_window)))
    long = df.select(*keys, window, F.posexplode(frames).alias("_f", "_values")).withColumn("_w", weights[F.col("_f")])
    long = long.join(n, keys).withColumn("t", F.col(window) * half + F.col("_f")).where(F.col("t") < F.col("_windows") * half)
    long = long.select(*keys, "t", "_w", F.posexplode("_values").alias("cls", "_x"))
    return long.groupBy(*keys, "t", "cls").agg((F.sum(F.col("_x") * F.col("_w")) / (F.sum("_w") + 1e-8)).alias("value"))


def stitched(scores: np.ndarray) -> np.ndarray:
    """As ``overlap_added`` for the windows (n, frames, classes) of one clip: (t, classes)."""
    n, f, c = scores.shape
    half, weights = f // 2, window_weights(f)
    total, weight, first = np.zeros((n * half + f, c)), np.zeros(n * half + f), np.arange(n) * half
    for j, w in enumerate(weights):
        total[first + j] += scores[:, j] * w
        weight[first + j] += w
    return total[: n * half] / (weight[: n * half, None] + 1e-8)


def greedy(df: DataFrame, values: Column) -> DataFrame:
    """df with label, its best class, and prob, that class's probability."""
    lp = C.log_softmax(values)
    return df.withColumn("_lp", lp).withColumn("label", C.argmax(F.col("_lp"))).withColumn("prob", F.exp(F.array_max("_lp"))).drop("_lp")


def span_confidence(spans: DataFrame, probs: DataFrame, keys: list[str], span: str) -> DataFrame:
    """keys, span, confidence: from probs (keys, span, t, p) of each span's frames.

    Frames count if they have over half of the first one's probability, or over 0.1, the first always;
    their mean, or the best one if the mean is under half of it.
    """
    first = probs.groupBy(*keys, span).agg(F.min_by("p", "t").alias("_p0"), F.min("t").alias("_t0"))
    p = probs.join(first, [*keys, span]).withColumn("_ok", (F.col("t") == F.col("_t0")) | (F.col("p") > F.col("_p0") / 2) | (F.col("p") > 0.1))
    g = p.groupBy(*keys, span).agg(F.avg(F.when(F.col("_ok"), F.col("p"))).alias("_mean"), F.max("p").alias("_top"))
    conf = F.when(F.col("_mean") < F.col("_top") / 2, F.col("_top")).otherwise(F.col("_mean"))
    return spans.join(g.select(*keys, span, conf.alias("confidence")), [*keys, span])


def weighted_pool(df: DataFrame, keys: list[str], weight: Column, vector: Column) -> DataFrame:
    """keys, dim, value: mean of vectors by weight; the plain mean where weights sum to 0."""
    long = df.select(*keys, weight.alias("_w"), F.posexplode(vector).alias("dim", "_x"))
    g = long.groupBy(*keys, "dim").agg(F.sum(F.col("_w") * F.col("_x")).alias("_wx"), F.sum("_w").alias("_ws"), F.avg("_x").alias("_mean"))
    return g.select(*keys, "dim", F.when(F.col("_ws") > 0, F.col("_wx") / F.col("_ws")).otherwise(F.col("_mean")).alias("value"))
