"""Exports: text grids, JSON documents, embeddings and the table behind an alignment plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUM = "%.6f"


def interval_label(label: Column, confidence: Column | None = None) -> Column:
    return label if confidence is None else F.concat(label, F.lit(" ("), F.round(confidence.cast("decimal(10,6)"), 2).cast("decimal(10,2)").cast("string"), F.lit(")"))


def tier(name: Column, items: Column, xmax: Column) -> Column:
    """Text of one interval tier from an ordered ARRAY<STRUCT<xmin, xmax, text>> in seconds."""
    lines = F.transform(
        items,
        lambda i, k: F.concat(
            F.format_string("        intervals [%d]:\n", k + 1), F.format_string(f"            xmin = {_NUM}\n            xmax = {_NUM}\n", i["xmin"], i["xmax"]),
            F.lit('            text = "'), F.regexp_replace(i["text"], '"', '""'), F.lit('"\n'),
        ),
    )
    head = F.concat(F.lit('        class = "IntervalTier"\n        name = "'), name, F.format_string(f'"\n        xmin = 0\n        xmax = {_NUM}\n', xmax), F.format_string("        intervals: size = %d\n", F.size(items)))
    return F.concat(head, F.array_join(lines, ""))


def text_grids(spans: DataFrame, keys: list[str], tier_no: str, tier_name: str, order: list[str]) -> DataFrame:
    """keys, grid: one text per key from rows of tiers (xmin, xmax in seconds, text); empty tiers don't appear.

    A key is a clip's segment: a few hundred rows, bounded by its length in time.
    """
    item = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "xmin", "xmax", "text")
    tiers = spans.groupBy(*keys, tier_no, tier_name).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.max("xmax").alias("_max"))
    top = tiers.groupBy(*keys).agg(F.max("_max").alias("_top"))
    body = tiers.join(top, keys).select(*keys, tier_no, "_top", tier(F.col(tier_name), F.col("_items"), F.col("_top")).alias("_text"))
    g = body.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(tier_no, "_text"))).alias("_t"), F.first("_top").alias("_top"))
    parts = F.transform("_t", lambda t, k: F.concat(F.format_string("    item [%d]:\n", k + 1), t["_text"]))
    head = F.format_string(f'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = {_NUM}\ntiers? <exists>\nsize = %d\nitem []:\n', F.col("_top"), F.size("_t"))
    return g.select(*keys, F.concat(head, F.array_join(parts, "")).alias("grid"))


def document_grids(documents: DataFrame, keys: list[str], confidence: bool = False) -> DataFrame:
    """keys, grid: text grids of segment documents with tiers of phonemes, words and, where there is one, the group track."""
    tiers = [("phoneme_ts", "phoneme_label", "phonemes"), ("words_ts", "word", "words"), ("group_ts", "group_label", "groups")]
    rows = None
    for no, (field, label, name) in enumerate(tiers, 1):
        if field in documents.columns:
            t = documents.select(*keys, F.posexplode(field).alias("k", "_t"))
            shown = interval_label(F.col(f"_t.{label}"), F.col("_t.confidence") if confidence else None)
            t = t.select(*keys, F.lit(no).alias("tier_no"), F.lit(name).alias("tier"), "k", (F.col("_t.start_ms") / 1000).alias("xmin"), (F.col("_t.end_ms") / 1000).alias("xmax"), shown.alias("text"))
            rows = t if rows is None else rows.unionByName(t)
    return text_grids(rows, keys, "tier_no", "tier", ["xmin", "k"])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; characters stay as they are."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Vectors of aligned rows (``align(..., vectors=True)``) as Parquet, without failed rows."""
    track = [c for c in ("track",) if c in df.columns]
    df.where("error IS NULL").select("clip_id", "seg_idx", *track, "pos", "label", "vector").write.mode("overwrite").parquet(path)


def write_grids(grids: DataFrame, path: str) -> None:
    """One text file per key's grid, as whole values in a text table."""
    grids.select("grid").write.mode("overwrite").text(path)


def confidence_band(confidence: Column) -> Column:
    """The colour band of an annotation."""
    return F.when(confidence > 0.9, "high").when(confidence > 0.6, "good").when(confidence > 0.1, "weak").otherwise("poor")


def annotations(df: DataFrame, keys: list[str], ms_per_frame: float) -> DataFrame:
    """keys, frame, label, confidence, band: what an alignment plot draws."""
    return df.select(*keys, F.floor(F.col("start_ms") / ms_per_frame).alias("frame"), "label", "confidence", confidence_band(F.col("confidence")).alias("band"))
