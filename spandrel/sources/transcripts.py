"""Transcripts: JSON files or rows with segments, checked and flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and its segments; what is no JSON of this shape has none."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", SCHEMA).alias("j"))
    return files.select("path", "j.segments")


def rejected(df: DataFrame, segments: str = "segments") -> Column:
    """Why a transcript can't be used, or null: no list of segments, or a segment without start, end or text."""
    bad = F.exists(segments, lambda s: s.isNull() | s["start"].isNull() | s["end"].isNull() | s["text"].isNull())
    return F.when(F.col(segments).isNull(), "missing 'segments' key").when(bad, "missing required keys")


def flattened(df: DataFrame, key: str, segments: str = "segments") -> DataFrame:
    """key, seg_idx, start_s, end_s, text: one row per segment of the usable transcripts."""
    good = df.where(rejected(df, segments).isNull())
    s = good.select(key, F.posexplode(segments).alias("seg_idx", "_s"))
    return s.select(key, "seg_idx", F.col("_s.start").alias("start_s"), F.col("_s.end").alias("end_s"), F.col("_s.text").alias("text"))


def unpaired(transcripts: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: a batch whose sizes don't match."""
    t, c = transcripts.select(key, F.lit(True).alias("_t")).distinct(), clips.select(key, F.lit(True).alias("_c")).distinct()
    return t.join(c, key, "full_outer").where(F.col("_t").isNull() | F.col("_c").isNull()).select(key, F.when(F.col("_t").isNull(), "transcript").otherwise("clip").alias("missing"))


def sentence_envelope(df: DataFrame, samples: Column, text: Column, rate: int = 16_000) -> DataFrame:
    """df with segments: one segment over the whole clip, its text trimmed."""
    one = F.struct(F.lit(0.0).alias("start"), (samples / F.lit(float(rate))).alias("end"), F.trim(text).alias("text"))
    return df.withColumn("segments", F.array(one))
