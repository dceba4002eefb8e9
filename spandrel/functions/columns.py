"""Column expressions over arrays: no Python runs for any of these."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = math.log(1e-8)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row and not once for an element of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_softmax(logits: Column) -> Column:
    """Stable log-softmax of an array."""
    return let(
        F.array_max(logits),
        lambda top: let(F.ln(total(F.transform(logits, lambda x: F.exp(x - top)))) + top, lambda norm: F.transform(logits, lambda x: x - norm)),
    )


def boosted(log_probs: Column, targets: Column, boost: float, blank: int) -> Column:
    """boost added to every distinct target class, the blank excepted, and renormalised."""
    raised = F.transform(log_probs, lambda x, i: F.when(F.array_contains(targets, i.cast("int")) & (i != blank), x + boost).otherwise(x))
    return log_softmax(raised)


def floored(log_probs: Column, targets: Column, blank: int, floor: float = LOG_FLOOR) -> Column:
    """Target classes raised to the floor; not renormalised."""
    return F.transform(log_probs, lambda x, i: F.when(F.array_contains(targets, i.cast("int")) & (i != blank), F.greatest(x, F.lit(floor))).otherwise(x))


def argmax(values: Column) -> Column:
    """Index from 0 of the largest value, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rms_normalised(samples: Column) -> Column:
    """Samples divided by their root mean square; unchanged if that is 0."""
    rms = F.sqrt(total(F.transform(samples, lambda v: v * v)) / F.size(samples))
    return let(rms, lambda r: F.when(r > 0, F.transform(samples, lambda v: v / r)).otherwise(samples))


def down_mixed(left: Column, right: Column) -> Column:
    """Mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def windows(samples: Column, size: int, stride: int) -> Column:
    """Complete windows of an array; the tail is dropped."""
    count = F.floor((F.size(samples) - size) / F.lit(stride)) + 1
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(0), ((count - 1) * stride).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(samples, s + 1, F.lit(size)))


def large_windows(samples: Column, rate: int = 16_000, window_ms: int = 3000, stride_ms: int = 250) -> Column:
    """Complete windows for whole utterances."""
    return windows(samples, window_ms * rate // 1000, stride_ms * rate // 1000)


def chop_code(start_s: Column, end_s: Column, available: Column, rate: int = 16_000, least: int = 800) -> Column:
    """-1 if fewer than the least samples are asked for, -2 if there are fewer, else 0."""
    asked = F.floor(end_s * rate) - F.floor(start_s * rate)
    there = F.least(F.floor(end_s * rate), available) - F.floor(start_s * rate)
    return F.when(asked < least, -1).when(there < least, -2).otherwise(0)


def chopped(samples: Column, start_s: Column, end_s: Column, rate: int = 16_000, longest_s: float = 30.0) -> Column:
    """The samples between two times, at most the longest."""
    first = F.floor(start_s * rate)
    n = F.least(F.floor(end_s * rate) - first, F.lit(int(longest_s * rate)))
    return rms_normalised(F.slice(samples, (first + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")))


def frame_count(length: Column, window: int, stride: int, per_window: int) -> Column:
    """Frames of a clip after overlap-add; null if fewer than 2."""
    short = F.ceil(F.lit(float(per_window)) * length / window)
    long = F.floor(F.floor((length - window) / stride + 1) * per_window / 2)
    n = F.when(length <= window, short).otherwise(long)
    return F.when(n >= 2, n).cast("bigint")


def frame_count_legacy(length: Column, window: int, stride: int, per_window: int) -> Column:
    """The rule without a branch for short clips."""
    n = F.floor(F.floor((length - window) / stride + 1) * per_window / 2)
    return F.when(n >= 2, n).cast("bigint")


def layer_size(length: Column, layers: list[tuple[int, int, int]]) -> Column:
    """Length after convolutions of (kernel, stride, padding)."""
    for k, s, p in layers:
        length = F.floor((length + 2 * p - k) / s) + 1
    return length


def receptive_field(layers: list[tuple[int, int, int]]) -> int:
    """Samples that one output value depends on."""
    field = 1
    for k, s, _ in reversed(layers):
        field = (field - 1) * s + k
    return field


def frame_ms(frame: Column, samples: Column, frames: Column, rate: int = 16_000, offset_s: float = 0.0) -> Column:
    """Time of a frame's edge in milliseconds; 0 frames have no duration."""
    return (F.when(frames > 0, frame * (samples / F.lit(float(rate)) / frames)).otherwise(0.0) + offset_s) * 1000


def run_lengths(values: Column) -> Column:
    """Array of (value, count) of equal neighbours; for arrays that fit a row."""
    start = F.array().cast("array<struct<value:int,count:int>>")

    def add(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["value"].alias("value"), (last["count"] + 1).cast("int").alias("count"))))
        return F.when((F.size(acc) > 0) & last["value"].eqNullSafe(v), longer).otherwise(F.concat(acc, F.array(F.struct(v.cast("int").alias("value"), F.lit(1).alias("count")))))

    return F.aggregate(values, start, add)


def expanded(runs: Column) -> Column:
    """The inverse of run_lengths."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["count"])))


def compressed(x: Column, factor: float = 1.0, floor: float = 1e-5) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)) * factor)


def decompressed(x: Column, factor: float = 1.0) -> Column:
    return F.exp(x) / factor


def ctc_stride(targets: Column, frames: Column) -> Column:
    """Places between targets on the path: the first of 4, 3, 2 that fits the frames, else 1."""
    n = F.size(targets)
    return F.when(4 * n + 1 <= frames, 4).when(3 * n + 1 <= frames, 3).when(2 * n + 1 <= frames, 2).otherwise(1)


def ctc_path(targets: Column, stride: Column, blank: int) -> Column:
    """Targets at 1, 1 + stride, ..., blanks around them."""
    parts = F.transform(targets, lambda t: F.concat(F.array(t.cast("int")), F.array_repeat(F.lit(blank), (stride - 1).cast("int"))))
    return F.concat(F.array(F.lit(blank)), F.flatten(parts))


def band_width(path_length: Column, divisor: int = 4, least: int = 20) -> Column:
    return F.when(path_length > 60, F.greatest(F.floor(path_length / divisor), F.lit(least))).otherwise(0)


def coverage(target_ids: Column, aligned_ids: Column) -> Column:
    """Set coverage of target ids by aligned ids."""
    t, a = F.array_distinct(target_ids), F.array_distinct(aligned_ids)
    both, missing, extra = F.size(F.array_intersect(t, a)), F.array_except(t, a), F.array_except(a, t)
    ratio = F.when(F.size(t) > 0, both / F.size(t)).otherwise(1.0)
    return F.struct(
        F.size(t).alias("target_count"), F.size(a).alias("aligned_count"), F.size(missing).alias("missing_count"), F.size(extra).alias("extra_count"),
        ratio.alias("coverage_ratio"), missing.alias("missing_ids"), extra.alias("extra_ids"), (ratio < 0.8).alias("bad_alignment"),
    )
