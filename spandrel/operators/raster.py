"""Labelled intervals on a grid of frames, and closing the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators import islands

#: Frames of an interval that are made at once, and of a slice; length of the slices that intervals are scanned in.
SLICE, PIECE_MS = 4_096, 60_000.0


def rasterised(df: DataFrame, keys: list[str], start_ms: Column, end_ms: Column, label: Column, tie: list[str], ms_per_frame: float) -> DataFrame:
    """keys, frame, label: each frame that an interval touches, one wider on each side; the interval that starts first has it.

    Frames count from the first start of the key.  Slices of a key's time are swept apart, in the order
    of starts, and an interval gets the frames beyond the latest end so far; so each frame is made once.  Intervals without two finite times, or not ending after
    their start, are left out.  Long ones become frames by slices of SLICE, so no array is larger.
    """
    s, e = start_ms.cast("double"), end_ms.cast("double")
    ok = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (e > s) & (s > float("-inf")) & (e < float("inf"))
    ties = [f"_t{i}" for i in range(len(tie))]
    r = df.where(ok).select(*keys, s.alias("_s"), e.alias("_e"), label.alias("label"), *(F.col(c).alias(t) for c, t in zip(tie, ties)), F.floor(s / PIECE_MS).alias("_slice"))
    # a row for each key and slice: first start and last end of the key, last end of the slices before
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    n = r.groupBy(*keys, "_slice").agg(F.min("_s").alias("_a"), F.max("_e").alias("_b"))
    n = n.select(*keys, "_slice", F.min("_a").over(whole).alias("_s0"), F.max("_b").over(whole).alias("_e1"), F.max("_b").over(before).alias("_carry"))
    r = islands.joined_by_slice(r, n, keys)
    own = Window.partitionBy(*keys, "_slice").orderBy("_s", *ties).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_top", F.greatest(F.col("_carry"), F.max("_e").over(own)))
    frames = F.ceil((F.col("_e1") - F.col("_s0")) / ms_per_frame)
    stop = lambda c: F.least(F.ceil((F.col(c) - F.col("_s0")) / ms_per_frame) + 1, frames)
    lo = F.greatest(F.floor((F.col("_s") - F.col("_s0")) / ms_per_frame) - 1, F.lit(0))
    # intervals that start earlier have all frames from lo to their latest end
    r = r.withColumn("_lo", F.greatest(lo, F.when(F.col("_top").isNotNull(), stop("_top")))).withColumn("_hi", stop("_e") - 1).where("_lo <= _hi")
    r = r.withColumn("_lo", F.explode(F.sequence("_lo", "_hi", F.lit(SLICE).cast("bigint"))))
    return r.select(*keys, F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + (SLICE - 1), F.col("_hi")))).alias("frame"), "label")


def closed(frames: DataFrame, keys: list[str], most: int) -> DataFrame:
    """frames with the gaps between them closed from both sides.

    Gaps of up to ``most`` frames go to the left; up to twice as many are parted in the middle, the
    smaller half to the left; of longer ones ``most`` frames on each side.
    """
    f = frames.select(*keys, "frame", "label", F.floor(F.col("frame") / SLICE).alias("_slice"))
    own = Window.partitionBy(*keys, "_slice").orderBy("frame")
    n = f.groupBy(*keys, "_slice").agg(F.min("frame").alias("_f"), F.min_by("label", "frame").alias("_l"))
    after = Window.partitionBy(*keys).orderBy("_slice")
    n = n.select(*keys, "_slice", F.lead("_f").over(after).alias("_f"), F.lead("_l").over(after).alias("_l"))
    g = f.withColumn("_next", F.lead("frame").over(own)).withColumn("_right", F.lead("label").over(own))
    last = F.col("_next").isNull()
    g = islands.joined_by_slice(g.where(last | (F.col("_next") > F.col("frame") + 1)), n, keys)
    g = g.withColumn("_right", F.when(last, F.col("_l")).otherwise(F.col("_right"))).withColumn("_next", F.coalesce("_next", "_f"))
    g = g.where(F.col("_next") > F.col("frame") + 1).withColumn("_n", F.col("_next") - F.col("frame") - 1)
    k = F.col("_k")
    g = g.withColumn("_k", F.explode(F.expr("sequence(1L, _n)")))
    left = F.when(F.col("_n") <= most, F.lit(True)).when(F.col("_n") <= 2 * most, k <= F.floor(F.col("_n") / 2)).otherwise(k <= most)
    right = F.when(F.col("_n") <= 2 * most, ~left).otherwise(k > F.col("_n") - most)
    filled = g.select(*keys, (F.col("frame") + k).alias("frame"), F.when(left, F.col("label")).when(right, F.col("_right")).alias("label"))
    return frames.select(*keys, "frame", "label").unionByName(filled.where("label IS NOT NULL"))
