"""Runs, gaps and neighbours in ordered sequences.

A sequence is cut into slices by an expression that doesn't fall along its order (a day, a stretch of
time).  Every slice is scanned by itself; a narrow row per slice carries counts and end values across.
So a key that holds most rows is scanned by many tasks, and nothing is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], piece: Column, order: list, value: Column) -> DataFrame:
    """df with idx, the place in the sequence from 0, and run, the number from 0 of its run of equal values."""
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    d = df.withColumn("_slice", piece).withColumn("_v", value)
    d = d.withColumn("_n", F.row_number().over(own)).withColumn("_prev", F.lag("_v").over(own))
    d = d.withColumn("_c", F.when((F.col("_n") == 1) | F.col("_v").eqNullSafe(F.col("_prev")), 0).otherwise(1))
    d = d.withColumn("_c", F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    s = d.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.max("_c").alias("_changes"), F.min_by("_v", "_n").alias("_first"), F.max_by("_v", "_n").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_new", F.when(F.lag("_rows").over(across).isNull() | F.lag("_last").over(across).eqNullSafe(F.col("_first")), 0).otherwise(1))
    s = s.withColumn("_idx0", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    s = s.withColumn("_run0", F.coalesce(F.sum(F.col("_changes") + F.col("_new")).over(before), F.lit(0)) + F.col("_new"))
    s = s.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), "_idx0", "_run0")
    on = d["_slice"].eqNullSafe(s["_s"])
    for i, k in enumerate(keys):
        on = on & d[k].eqNullSafe(s[f"_k{i}"])
    joined = d.join(s, on)
    return joined.select(*(d[c] for c in df.columns), (F.col("_idx0") + F.col("_n") - 1).alias("idx"), (F.col("_run0") + F.col("_c")).alias("run"))


def indexed(df: DataFrame, keys: list[str], piece: Column, order: list) -> DataFrame:
    """df with idx, the place in the sequence from 0; slices are only counted before they are numbered."""
    d = df.withColumn("_slice", piece)
    s = d.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_idx0"))
    on = d["_slice"].eqNullSafe(s["_s"])
    for i, k in enumerate(keys):
        on = on & d[k].eqNullSafe(s[f"_k{i}"])
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbers = d.withColumn("_n", F.row_number().over(own))
    return numbers.join(s, on).select(*(numbers[c] for c in df.columns), (F.col("_idx0") + F.col("_n") - 1).alias("idx"))


def run_table(df: DataFrame, keys: list[str], piece: Column, order: list, value: Column) -> DataFrame:
    """keys, run, value, first_idx, n: run-length encoding of each sequence."""
    return numbered(df, keys, piece, order, value).withColumn("value", value).groupBy(*keys, "run").agg(F.first("value").alias("value"), F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


def expanded_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, value: the sequences of a run-length encoding."""
    return runs.select(*keys, "value", F.explode(F.sequence(F.col("first_idx"), F.col("first_idx") + F.col("n") - 1)).alias("idx"))


def hopping(df: DataFrame, keys: list[str], piece: Column, order: list, size: int, stride: int) -> DataFrame:
    """Each row of a sequence once for each complete window of size rows that it is in, as column w."""
    d = indexed(df, keys, piece, order)
    last = d.groupBy(*keys).agg(F.max("idx").alias("_last"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (size - 1)) / stride)).cast("bigint")
    w = d.join(last, keys).withColumn("_top", F.least(F.floor(F.col("idx") / stride), F.floor((F.col("_last") + 1 - size) / stride)))
    return w.where(F.col("_top") >= first).withColumn("w", F.explode(F.sequence(first, F.col("_top")))).drop("_last", "_top")


def joined_by_slice(df: DataFrame, narrow: DataFrame, keys: list[str], slice_name: str = "_slice") -> DataFrame:
    """df with the further columns of narrow, which has a row for each key and slice; nulls are equal."""
    n = narrow.select(*(F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)), F.col(slice_name).alias("_ns"), *(c for c in narrow.columns if c not in (*keys, slice_name)))
    on = df[slice_name].eqNullSafe(n["_ns"])
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(n[f"_n{i}"])
    return df.join(n, on).drop("_ns", *(f"_n{i}" for i in range(len(keys))))


def silent_runs(df: DataFrame, keys: list[str], idx: str, prob: Column, rules: dict[int, tuple[int, float, Column | None]], slice_rows: int = 65_536) -> DataFrame:
    """keys, step, start_idx, end_idx: for each rule (k, threshold, which rows it is for) the stretches where the mean of k values from each place on reaches the threshold.

    A stretch ends k - 1 after its last place, and at the end of the sequence if it gets there.
    Sequences are scanned in slices that also have the first rows of the next one, once for all rules;
    only the stretches at the edges of slices meet in a window over a sequence.
    """
    most = max(k for k, *_ in rules.values())
    d = df.select(*keys, F.col(idx).cast("bigint").alias("_at"), prob.alias("_p"), *(F.coalesce(c, F.lit(False)).alias(f"_for{s}") for s, (*_, c) in rules.items() if c is not None))
    at = F.floor(F.col("_at") / slice_rows)
    last = d.groupBy(*keys).agg((F.max("_at") + 1).alias("_len"))
    d = d.withColumn("_slice", F.explode(F.when((F.col("_at") % slice_rows < most - 1) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))))
    own = Window.partitionBy(*keys, "_slice").orderBy("_at")
    on = []
    for step, (k, threshold, only) in rules.items():
        ahead = own.rowsBetween(0, k - 1)
        flag = (F.count(F.lit(1)).over(ahead) == k) & (F.sum("_p").over(ahead) / k >= threshold)
        d = d.withColumn(f"_on{step}", flag if only is None else flag & F.col(f"_for{step}"))
        on.append(F.when(F.col(f"_on{step}"), F.lit(step)))
    flags = d.where(F.floor(F.col("_at") / slice_rows) == F.col("_slice")).select(*keys, "_slice", "_at", F.explode(F.array_compact(F.array(*on))).alias("step"))
    g = flags.withColumn("_g", F.col("_at") - F.row_number().over(Window.partitionBy(*keys, "_slice", "step").orderBy("_at")))
    runs = g.groupBy(*keys, "_slice", "step", "_g").agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    edge = (F.col("_a") == F.col("_slice") * slice_rows) | (F.col("_b") == (F.col("_slice") + 1) * slice_rows - 1)
    across = Window.partitionBy(*keys, "step").orderBy("_a")
    e = runs.where(edge).withColumn("_new", F.coalesce((F.col("_a") > F.lag("_b").over(across) + 1).cast("int"), F.lit(1)))
    e = e.withColumn("_g", F.sum("_new").over(across)).groupBy(*keys, "step", "_g").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    runs = runs.where(~edge).select(*keys, "step", "_a", "_b").unionByName(e.select(*keys, "step", "_a", "_b")).join(last, keys)
    width = F.create_map(*(F.lit(x) for step, (k, *_) in rules.items() for x in (step, k)))[F.col("step")]
    end = F.when(F.col("_b") == F.col("_len") - width, F.col("_len")).otherwise(F.col("_b") + width)
    return runs.select(*keys, "step", F.col("_a").alias("start_idx"), end.cast("bigint").alias("end_idx"))


def silences(df: DataFrame, keys: list[str], idx: str, prob: Column, k: int, threshold: float, slice_rows: int = 65_536) -> DataFrame:
    """keys, start_idx, end_idx of the silent stretches by one rule."""
    return silent_runs(df, keys, idx, prob, {0: (k, threshold, None)}, slice_rows).drop("step")


def silence_ladder(df: DataFrame, keys: list[str], idx: str, prob: Column, k: int, targets: str) -> DataFrame:
    """Silent stretches by the first of three rules that finds any in a sequence; the last two only for over 200 targets."""
    many = F.col(targets) > 200
    rules = {0: (k, 0.9, None), 1: (k, max(0.05, 1 - 0.09 * k), many)} | ({2: (3, 0.9, many)} if k > 3 else {})
    parts = silent_runs(df, keys, idx, prob, rules)
    best = parts.groupBy(*keys).agg(F.min("step").alias("step"))
    return parts.join(best, [*keys, "step"], "left_semi").select(*keys, "start_idx", "end_idx", "step")
