"""Targets against what was aligned: counts, repeats, gaps, scores, words and totals.

Tables are joined and grouped by segment and target; no segment is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators import islands

#: Length of the slices that a segment's rows are scanned in.
PIECE_MS = 60_000.0
SEGMENT = ["clip_id", "seg_idx"]


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key, the last by the given columns; partial maxima are taken before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns))
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*by)).alias("_r"))
    return best.select("_r.*")


def targets(segments: DataFrame, ids: str = "ph66") -> DataFrame:
    """clip_id, seg_idx, target_idx, phoneme_id, n_targets."""
    return segments.select(*SEGMENT, F.size(ids).alias("n_targets"), F.posexplode(ids).alias("target_idx", "phoneme_id"))


def decoded(rows: DataFrame, alphabet: DataFrame, default_group: int = 16) -> DataFrame:
    """rows with label and group_id of their phoneme_id; unknown ids are UNK_id and the default group.

    The alphabet is a dimension of a few dozen rows; Spark broadcasts it by its size.
    """
    names = alphabet.select("phoneme_id", F.col("phoneme_label").alias("_label"), "group_id")
    joined = rows.drop("group_id").join(names, "phoneme_id", "left")
    label = F.coalesce("_label", F.concat(F.lit("UNK_"), F.col("phoneme_id").cast("string")))
    return joined.withColumn("label", label).withColumn("group_id", F.coalesce("group_id", F.lit(default_group))).drop("_label")


def target_counts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """How often each target was aligned, 0 included."""
    n = rows.where(F.col("target_seq_idx") >= 0).groupBy(*SEGMENT, F.col("target_seq_idx").alias("target_idx")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, [*SEGMENT, "target_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def invalid_rows(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose target index is none of their segment's."""
    idx = wanted.select(*SEGMENT, F.col("target_idx").alias("target_seq_idx"))
    return rows.join(idx, [*SEGMENT, "target_seq_idx"], "left_anti")


def longest_per_target(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """keys, start, end: repeated stretches of a key joined where they touch, then the longest, the earliest on ties."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    r = rows.select(*keys, start.alias("start"), end.alias("end")).where(F.col("end") > F.col("start"))
    r = r.groupBy(*keys, "start").agg(F.max("end").alias("end"))  # repeated rows end here, before the sort
    opens = F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_g", F.coalesce(opens.cast("int"), F.lit(1)))
    r = r.withColumn("_g", F.sum("_g").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return r.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("_b")).select(*keys, "_b.start", "_b.end")


def estimated(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Start and end of each missing target, spread evenly between its neighbours.

    A window holds one segment's targets, which come from one array in one row.

    found: clip_id, seg_idx, target_idx, start, end, once for each target.  Leading gaps end at the
    first found target and have one unit for each; trailing ones start at the last; segments without
    any found target start at 0.
    """
    own = Window.partitionBy(*SEGMENT).orderBy("target_idx")
    t = wanted.join(found, [*SEGMENT, "target_idx"], "left")
    t = t.withColumn("_before", F.last("end", True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("_after", F.first("start", True).over(own.rowsBetween(1, Window.unboundedFollowing)))
    t = t.where(F.col("start").isNull()).withColumn("_g", F.col("target_idx") - F.row_number().over(own))
    g = Window.partitionBy(*SEGMENT, "_g")
    t = t.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_k", F.row_number().over(g.orderBy("target_idx")) - 1)
    lo = F.coalesce("_before", F.greatest(F.lit(0), F.col("_after") - F.col("_n")), F.lit(0))
    hi = F.coalesce("_after", lo + F.col("_n"))
    step = F.greatest(hi - lo, F.col("_n")) / F.col("_n")
    a = F.floor(lo + F.col("_k") * step)
    return t.select(*SEGMENT, "target_idx", "phoneme_id", a.alias("est_start"), F.greatest(F.floor(lo + (F.col("_k") + 1) * step), a + 1).alias("est_end"))


def word_spans(rows: DataFrame, keys: list[str], order: list[str], word: Column, legacy: bool = False) -> DataFrame:
    """Runs of equal word numbers rolled up: start, end, mean confidence, number of phones.

    legacy: the last word of a segment is left out if it has one phone, as in older outputs.
    """
    r = islands.numbered(rows.withColumn("_word", word), keys, F.floor(F.col("start_ms") / PIECE_MS), order, F.col("_word"))
    out = r.groupBy(*keys, "run").agg(
        F.first("_word").alias("word"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("phones")
    )
    if legacy:
        last = F.max("run").over(Window.partitionBy(*keys))
        out = out.withColumn("_last", last).where((F.col("run") < F.col("_last")) | (F.col("phones") > 1)).drop("_last")
    return out


def confidence_report(rows: DataFrame, least: int = 60, threshold: float = 0.6) -> DataFrame:
    """Per segment: phones, ratio of weak ones, mean near the start and near the end, and whether it looks bad."""
    n = rows.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    r = islands.indexed(rows, SEGMENT, F.floor(F.col("start_ms") / PIECE_MS), ["start_ms", "row_id"]).withColumnRenamed("idx", "_i").join(n, SEGMENT)
    early = F.when((F.col("_i") >= 10) & (F.col("_i") < 30), F.col("confidence"))
    late = F.when((F.col("_i") >= F.col("_n") - 30) & (F.col("_i") < F.col("_n") - 10), F.col("confidence"))
    out = r.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("phones"), F.avg((F.col("confidence") < 0.5).cast("double")).alias("weak"), F.avg(early).alias("early"), F.avg(late).alias("late")
    )
    bad = (F.col("weak") > threshold) | ((F.col("early") > 0.1) & (F.col("late") < 0.1))
    return out.withColumn("bad", bad)


def label_index(rows: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """label, n, known: how often each label occurs and whether it is one of the known ones."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    names = known.select(F.col(known.columns[0]).alias("label"), F.lit(True).alias("_k")).distinct()
    return counts.join(names, "label", "left").select("label", "n", F.coalesce("_k", F.lit(False)).alias("known"))


def duplicate_labels(table: DataFrame, label: str, group: str) -> DataFrame:
    """group, n, spellings: rows and distinct labels of each group; they differ where a label is repeated."""
    return table.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("spellings"))
