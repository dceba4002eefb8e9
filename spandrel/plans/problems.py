"""The queries of the general problems: interval unions and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import intervals, nested
from spandrel.session import spread, table

SEGMENT = ["clip_id", "seg_idx"]
#: The child tables of a segment, and which scalar stands for an element that is an object.
CHILDREN = ["phoneme_ts", "words", "missing_phonemes", "extra_phonemes"]
ITEM_FIELDS = {"phoneme_ts": "phoneme_label"}


def _states(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_states(table(spark, d, "phoneme_ts"), SEGMENT, F.col("start_ms"), F.col("end_ms"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_gaps(_states(spark, d), SEGMENT, 1_000)


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covered_periods(_states(spark, d), SEGMENT)


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, bool]]:
    df = spread(table(spark, d, "vs_records").select("record_id", "payload"), "record_id")
    return df, nested.array_levels(nested.merged_schema(df, "payload"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    df, levels = _records(spark, d)
    levels = {**{c: True for c in CHILDREN}, "segments": False, **levels}
    rows = nested.shred(df, "record_id", "payload", levels, CHILDREN, item_fields=ITEM_FIELDS)
    return rows.where("parent_tbl = 'segments'").select("record_id", F.col("parent_pos").alias("seg_pos"), F.col("tbl").alias("child"), F.col("ord").alias("child_pos"), "item")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    df, levels = _records(spark, d)
    rows = nested.shred(df, "record_id", "payload", {"segments": False, **levels}, ["segments"])
    coverage = {f"coverage_analysis.{c}": t for c, t in (("target_count", "int"), ("aligned_count", "int"), ("missing_count", "int"), ("extra_count", "int"), ("coverage_ratio", "double"), ("bad_alignment", "boolean"))}
    return nested.flat_table(rows, "segments", {"start": "double", "end": "double", "text": "string", **coverage})


def p5_phonemes(spark: SparkSession, d: str) -> DataFrame:
    df, levels = _records(spark, d)
    rows = nested.shred(df, "record_id", "payload", {"segments": False, "phoneme_ts": True, **levels}, ["phoneme_ts"])
    fields = {"phoneme_id": "int", "phoneme_label": "string", "ipa_label": "string", "start_ms": "double", "end_ms": "double", "confidence": "double", "is_estimated": "boolean", "target_seq_idx": "int", "index": "int"}
    return nested.flat_table(rows, "phoneme_ts", fields)


def p5_words(spark: SparkSession, d: str) -> DataFrame:
    df, levels = _records(spark, d)
    rows = nested.shred(df, "record_id", "payload", {"segments": False, "words": True, **levels}, ["words"])
    return nested.flat_table(rows, "words", {"item": "string"}).withColumnRenamed("item", "word")


def p5_missing_or_extra(spark: SparkSession, d: str) -> DataFrame:
    df, levels = _records(spark, d)
    rows = nested.shred(df, "record_id", "payload", {"segments": False, **{c: True for c in CHILDREN}, **levels}, CHILDREN[2:])
    missing, extra = (nested.flat_table(rows, c, {"item": "string"}).withColumn("kind", F.lit(c)) for c in CHILDREN[2:])
    return missing.unionByName(extra).withColumnRenamed("item", "phoneme_label")


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema, kinds as text."""
    return nested.merged_schema(spread(table(spark, d, "vs_records").select("record_id", "payload"), "record_id"), "payload").select("path", F.array_join("kinds", ",").alias("kinds"), "records")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_periods, p5_found, p5_segments, p5_phonemes, p5_words, p5_missing_or_extra, p5_schema)}


_INTERVALS = """
WITH r AS (
  SELECT clip_id, seg_idx, round_even(start_ms * 1000, 0)::BIGINT AS s, round_even(end_ms * 1000, 0)::BIGINT AS e
  FROM phoneme_ts
  WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL AND NOT isnan(start_ms) AND NOT isnan(end_ms) AND end_ms > start_ms),
m AS (
  SELECT *, max(e) OVER (PARTITION BY clip_id, seg_idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
"""


def _read(v: str) -> str:
    """A JSON value, or what it says if it is a text that is itself an array or object."""
    said = f"json_extract_string({v}, '$')"
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({said}, '^\\s*[\\[{{]') AND json_valid({said}) THEN json({said}) ELSE {v} END"


def _elements(v: str) -> str:
    """The elements of a JSON array, of a single value, or none of null."""
    return f"json_each(CASE WHEN json_type({v}) = 'ARRAY' THEN {v} WHEN json_type({v}) = 'NULL' OR json_extract_string({v}, '$') = 'null' THEN '[]'::JSON ELSE json_array({v}) END)"


_IN_FRONT = "".join(f"\\x{{{ord(c):X}}}" for c in nested.IN_FRONT)
#: A walk down to every key 'segments', then to the four lists of each segment.
_NESTED = f"""
WITH RECURSIVE p AS (SELECT record_id, regexp_replace(payload, '^[{_IN_FRONT}]+', '') AS t FROM vs_records),
ok AS (SELECT record_id, json(t) AS v FROM p WHERE json_valid(t)),
rec(record_id, ord, key, v) AS (
  SELECT record_id, []::BIGINT[], '', {_read("v")} FROM ok UNION ALL
  SELECT record_id, list_append(ord, e.id::BIGINT), e.key, {_read("e.value")}
  FROM rec, json_each(CASE WHEN json_type(v) IN ('ARRAY', 'OBJECT') AND rec.key <> 'segments' THEN v ELSE '[]'::JSON END) e),
seg AS (
  SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY ord, e.id) - 1 AS seg_pos, {_read("e.value")} AS s
  FROM (SELECT record_id, ord, v FROM rec WHERE key = 'segments') r, {_elements("r.v")} e),
cov AS (SELECT *, {_read("json_extract(s, '$.coverage_analysis')")} AS c FROM seg WHERE json_type(s) = 'OBJECT'),
lists AS (
  SELECT record_id, seg_pos, 'phoneme_ts' AS child, json_extract(s, '$.phoneme_ts') AS v FROM cov
  UNION ALL SELECT record_id, seg_pos, 'words', json_extract(s, '$.words') FROM cov
  UNION ALL SELECT record_id, seg_pos, 'missing_phonemes', json_extract(c, '$.missing_phonemes') FROM cov
  UNION ALL SELECT record_id, seg_pos, 'extra_phonemes', json_extract(c, '$.extra_phonemes') FROM cov),
said AS (SELECT record_id, seg_pos, child, {_read("v")} AS v FROM lists WHERE v IS NOT NULL),
el AS (SELECT record_id, seg_pos, child, e.key::INT AS child_pos, {_read("e.value")} AS x FROM said, {_elements("said.v")} e)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _NESTED
        + """SELECT record_id, seg_pos::INT AS seg_pos, child, child_pos, CASE WHEN child = 'phoneme_ts' THEN json_extract_string(x, '$.phoneme_label') ELSE json_extract_string(x, '$') END AS item
FROM el WHERE json_type(x) <> 'NULL'""",
        "p1_found": _INTERVALS + "SELECT clip_id, seg_idx, before AS gap_start_us, s AS gap_end_us FROM m WHERE s - before >= 1000",
        "p1_periods": _INTERVALS
        + """, o AS (SELECT *, CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END AS opens FROM m),
g AS (SELECT *, sum(opens) OVER (PARTITION BY clip_id, seg_idx ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period FROM o)
SELECT clip_id, seg_idx, min(s) AS period_start_us, max(e) AS period_end_us FROM g GROUP BY clip_id, seg_idx, period""",
    }
