"""The queries of the problems that prepare text for training, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import frequency, language, leakage, lookalikes, packing, percentiles, splitting
from spandrel.session import settled, spread, table

SEGMENT = ["clip_id", "seg_idx"]
LABELS = ["ipa_label", "phoneme_label"]
#: Percentiles that p3 reports.
AT = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _documents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *more, "text"), "doc_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "segments"), "seg_uid", "text", F.col("start_s"), F.col("end_s"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be split: those with a first piece of an oversized item."""
    return _pieces(spark, d).where("oversized AND piece = 0").select("seg_uid")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("oversized").drop("oversized")


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized item with the rules its pieces break: text not covered, a piece over a limit, no progress, overlap or its place, an end inside a word though a word ended after the overlap, times out of order."""
    p = _pieces(spark, d).where("oversized")
    row = F.struct("piece", "char_start", "char_end", "piece_text", "piece_start_s", "piece_end_s")
    g = p.groupBy("seg_uid").agg(F.array_sort(F.collect_list(row)).alias("p"), F.first("n_pieces").alias("n"))
    t = table(spark, d, "segments").select("seg_uid", "text", "start_s", "end_s")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    timed = F.coalesce((F.col("end_s") > F.col("start_s")) & ~F.isnan("start_s") & ~F.isnan("end_s"), F.lit(False))
    seconds = F.when(timed, F.col("end_s") - F.col("start_s")).otherwise(0.0)
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))
    over = lambda x: ((x["char_end"] - x["char_start"]) > 300) | F.coalesce(x["piece_end_s"] - x["piece_start_s"] > 30 + 1e-6, F.lit(False))
    torn = lambda x: (x["a"]["char_end"] < x["b"]["char_start"]) | (x["a"]["char_end"] >= x["b"]["char_end"]) | (x["a"]["char_start"] > x["b"]["char_start"])
    far = lambda x: x["a"]["char_end"] - x["b"]["char_start"] > 40
    inside = lambda x: ~F.substr(F.col("text"), x["a"]["char_end"] + 1, F.lit(1)).rlike(r"\s") & F.substr(x["a"]["piece_text"], F.lit(42)).rlike(r"\s\S")
    late = lambda x: F.coalesce((x["b"]["piece_start_s"] > x["a"]["piece_end_s"] + 1e-6) | (x["b"]["piece_end_s"] <= x["a"]["piece_end_s"]), F.lit(False))
    text_of = lambda x: x["piece_text"] != F.substr(F.col("text"), x["char_start"] + 1, x["char_end"] - x["char_start"])
    short = size * 30 < seconds  # less than a character for a piece: shared out without regard to words
    bad = (
        (F.size("p") != F.col("n")) | (F.col("p")[0]["char_start"] != 0) | (F.element_at("p", -1)["char_end"] != size) | F.exists("p", over)
        | (~short & (F.exists(pairs, torn) | F.exists(pairs, far) | F.exists(pairs, inside) | F.exists(pairs, late))) | F.coalesce(F.exists("p", text_of), F.lit(False))
    )
    return g.join(t, "seg_uid").select("seg_uid", bad.alias("faulty"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "phoneme_ts").select("phoneme_label", F.to_date("loaded_at").alias("loaded_on"), "confidence")
    return percentiles.sketches(rows, ["phoneme_label", "loaded_on"], F.col("confidence"), 0.0, 1.0)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per label over all days, put together from the sketches of each day."""
    return percentiles.percentiles(percentiles.merge_sketches(_daily(spark, d), ["phoneme_label"]), ["phoneme_label"], AT)


def p3_within_error(spark: SparkSession, d: str) -> DataFrame:
    """Per label, whether every percentile's rank among all values is within the error that the sketch states, by counting."""
    found = p3_percentiles(spark, d)
    good = table(spark, d, "phoneme_ts").where("confidence BETWEEN 0 AND 1").select("phoneme_label", "confidence")
    counted = percentiles.ranks(good, ["phoneme_label"], F.col("confidence"), found, list(AT))
    counted = counted.withColumnRenamed("phoneme_label", "_label")
    ok = F.lit(True)
    for x, q in AT.items():
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * q - 1e-9))
        ok = ok & (F.col(f"below_{x}") + 1 - F.col("rank_error") <= rank) & (rank <= F.col(f"to_{x}") + F.col("rank_error"))
    return found.join(counted, F.col("phoneme_label").eqNullSafe(F.col("_label"))).select("phoneme_label", "n", ok.alias("within"))


def p3_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_daily(spark, d), ["phoneme_label", "loaded_on"], AT)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    counts = settled(frequency.term_counts(table(spark, d, "phoneme_ts"), LABELS, SEGMENT))  # read for the terms and for their total
    return frequency.marked_terms(counts, LABELS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark IS NOT NULL").select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "occurrences", "records", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "alphabet").select("ipa_label")
    rows = table(spark, d, "phoneme_ts").select(F.col("row_id").alias("row_key"), "ipa_label")
    items = table(spark, d, "segments").select(F.col("seg_uid").alias("row_key"), F.posexplode("ipa").alias("pos", "label"))
    first = lookalikes.repair(rows, ["row_key"], "ipa_label", vocabulary).select(F.lit("ipa_label").alias("field"), "row_key", F.lit(-1).alias("pos"), "form")
    second = lookalikes.repair(items, ["row_key", "pos"], "label", vocabulary).select(F.lit("ipa").alias("field"), "row_key", "pos", "form")
    return first.unionByName(second)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every piece of every document; containers hold 2,048 tokens."""
    lengths = settled(packing.token_lengths(_documents(spark, d), "doc_id", "text"))
    return packing.pack(lengths, "doc_id", "n_tokens", (512, 1024, 2048))


def p7_by_length(spark: SparkSession, d: str) -> DataFrame:
    """As p7_containers where opening costs nothing, so that the three lengths compete for every container: containers, tokens and room by length."""
    lengths = settled(packing.token_lengths(_documents(spark, d), "doc_id", "text"))
    packed = packing.pack(lengths, "doc_id", "n_tokens", (512, 1024, 2048), opening=0).where("container IS NOT NULL")
    boxes = packed.groupBy("container", "capacity").agg(F.sum("n_tokens").alias("tokens"))
    return boxes.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("room"))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, and how many of p7_containers' documents and containers break a rule: split though not above 2,048 tokens, a gap between pieces, too full, an overlap."""
    packed = p7_containers(spark, d)
    docs = packed.where("n_tokens > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("piece").alias("numbers"))
    boxes = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("most"), F.max(F.col("place") + F.col("n_tokens")).alias("end"), F.countDistinct("place").alias("places"), F.count(F.lit(1)).alias("pieces"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = docs.agg(F.count(F.lit(1)).alias("documents"), n((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("split"), n((F.col("end") != F.col("n")) | (F.col("numbers") != F.col("pieces"))).alias("torn"))
    b = boxes.agg(n(F.col("n") > F.col("most")).alias("over_full"), n((F.col("end") != F.col("n")) | (F.col("places") != F.col("pieces"))).alias("overlapping"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _documents(spark, d), table(spark, d, "eval_items").select("item_id", F.col("text").alias("item_text"))
    return leakage.leaked(docs, "doc_id", "text", items, "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its longest run of words and where it stands in the document."""
    return _leaks(spark, d)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    model = language.fitted(table(spark, d, "lang_samples"), "lang", "text")
    return language.document_languages(_documents(spark, d, "lang"), "doc_id", "text", model, ["lang"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_languages(spark, d), "doc_id", "label")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "lang", "share", "words", "confidence")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    model = language.fitted(table(spark, d, "lang_samples"), "lang", "text")
    return language.language_spans(_documents(spark, d), "doc_id", "text", model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_pieces, p2_faults, p3_percentiles, p3_within_error, p3_daily_percentiles, p4_found, p4_terms, p6_found, p7_containers, p7_by_length, p7_faults, p8_found, p8_passages, p9_found, p9_languages, p9_spans)}
