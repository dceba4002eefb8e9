"""Queries over the test tables for the operators of alignment and interval analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.config import AlignConfig
from spandrel.functions import columns as C
from spandrel.operators import coverage, decoding, frames, islands, raster, signal, text
from spandrel.plans import pipeline
from spandrel.plans.catalogue_sql import SQL
from spandrel.sources import models, presets, sinks, transcripts
from spandrel.streaming import sessions
from spandrel.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEGMENT = ["clip_id", "seg_idx"]
#: Frames of a segment that the vectors of `embeddings` stand for, and its blank class.
LENGTH, BLANK = 50, 63
#: Labels of an alphabet that are collected; more are refused.
MOST_LABELS = 10_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- frames: the vectors of `embeddings`, in order, as scores of 64 classes


def _frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    scores = F.transform("embedding", lambda x: x.cast("double") * 20)
    return e.select("vec_id", F.floor(F.col("vec_id") / LENGTH).alias("seg"), (F.col("vec_id") % LENGTH).alias("t"), scores.alias("l"), "embedding", F.col("label").alias("own"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The first eight labels of a segment, in order: eight rows for each group."""
    f = _frames(spark, d).where("t < 8").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("own") + 1).cast("int").alias("x")))).alias("x"))
    return f.select("seg", F.transform("x", lambda x: x["x"]).alias("targets"))


@query
def frame_log_softmax(spark, d):
    f = _frames(spark, d).select("vec_id", F.posexplode(C.log_softmax(F.col("l"))).alias("cls", "lp"))
    return f.select("vec_id", "cls", F.round("lp", 5).alias("lp"))


@query
def target_boost_floor(spark, d):
    f = _frames(spark, d).join(_targets(spark, d), "seg").withColumn("lp", C.log_softmax(F.col("l")))
    f = f.withColumn("lp", C.boosted(F.col("lp"), F.col("targets"), 5.0, BLANK)).withColumn("lp", C.floored(F.col("lp"), F.col("targets"), BLANK))
    f = f.select("vec_id", "targets", F.posexplode("lp").alias("cls", "lp"))
    return f.where(F.array_contains("targets", F.col("cls"))).select("vec_id", "cls", F.round("lp", 5).alias("lp"))


def _greedy(spark, d):
    f = frames.greedy(_frames(spark, d), F.col("l"))
    return islands.numbered(f, ["seg"], F.floor(F.col("t") / 4096), ["t"], F.col("label")).where(F.col("label") != BLANK)


def _greedy_runs(spark, d):
    g = _greedy(spark, d).groupBy("seg", "run").agg(F.first("label").alias("label"), F.min("t").alias("start_frame"), (F.max("t") + 1).alias("end_frame"))
    return g


@query
def greedy_decode_runs(spark, d):
    return _greedy_runs(spark, d).select("seg", "label", "start_frame", "end_frame")


@query
def span_confidence(spark, d):
    g = _greedy(spark, d).select("seg", "run", "t", F.col("prob").alias("p"))
    s = frames.span_confidence(_greedy_runs(spark, d), g, ["seg"], "run")
    return s.select("seg", "label", "start_frame", F.round("confidence", 5).alias("confidence"))


@query
def frames_to_ms(spark, d):
    ms = lambda c: F.round(C.frame_ms(F.col(c), F.lit(64_000), F.lit(LENGTH)), 4)
    return _greedy_runs(spark, d).select("seg", "label", ms("start_frame").alias("start_ms"), ms("end_frame").alias("end_ms"))


@query
def weighted_pool(spark, d):
    p = frames.weighted_pool(_greedy(spark, d), ["seg", "run"], F.col("prob"), F.transform("embedding", lambda x: x.cast("double")))
    return p.select("seg", "run", "dim", F.round("value", 5).alias("value"))


@query
def overlap_add(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("l", k * 8 + 1, F.lit(8)))
    o = frames.overlap_added(_frames(spark, d), ["seg"], "t", parts, 8)
    return o.select("seg", F.col("t").cast("bigint").alias("t"), "cls", F.round("value", 4).alias("value"))


def _segments_of_frames(spark, d):
    """A segment per row: fifty frames each."""
    f = _frames(spark, d).groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("t", "l"))).alias("x"))
    return f.select("seg", F.transform("x", lambda x: x["l"]).alias("logits")).join(_targets(spark, d), "seg")


def _aligned(spark, d, mode="full", **settings):
    cfg = AlignConfig(**{"blank_id": BLANK, **settings})
    return decoding.align_segments(_segments_of_frames(spark, d), ["seg"], "logits", "targets", cfg, mode)


@query
def viterbi_path(spark, d):
    a = _aligned(spark, d, "simple")
    return a.select("seg", "label", "start_frame", "end_frame", "target_idx")


@query
def forced_align_full(spark, d):
    return _aligned(spark, d, extend_soft_boundaries=False)


@query
def segmented_align(spark, d):
    """With class 1, a target of every segment, as the silence to anchor on."""
    return _aligned(spark, d, silence_id=1, silence_anchors=2, silence_threshold=0.05, extend_soft_boundaries=False)


@query
def soft_boundaries(spark, d):
    return _aligned(spark, d, extend_soft_boundaries=True)


@query
def trailing_steal(spark, d):
    return _aligned(spark, d, ensure_completeness=True, boost_targets=False, enforce_minimum=False, extend_soft_boundaries=False)


@query
def forced_align_texts(spark, d):
    """The phones of every segment's text against 1 to 9 frames for each, so that all strides, the band and the long texts' rules run.

    Frames are made from hashes, with the target at each frame's place raised: a stand-in for a model's scores.
    """
    s = _segments(spark, d, "ph66").where("size(ph66) > 0").withColumn("n", F.size("ph66"))
    s = s.repartition(2 * spark.sparkContext.defaultParallelism, "seg_uid")  # few bytes, much work
    s = s.withColumn("t_n", F.col("n") * (F.pmod("seg_uid", F.lit(9)) + 1).cast("int"))
    noise = lambda t, c: F.pmod(F.xxhash64("seg_uid", t, c), F.lit(1000)) / 250.0
    own = lambda t: F.try_element_at("ph66", F.floor(t * F.col("n") / F.col("t_n")).cast("int") + 1)
    frame = lambda t: F.transform(F.sequence(F.lit(0), F.lit(66)), lambda c: noise(t, c) + F.when(c == own(t), 6.0).otherwise(0.0))
    s = s.select(*SEGMENT, "ph66", F.transform(F.sequence(F.lit(0), F.col("t_n") - 1), frame).alias("logits"))
    return decoding.align_segments(s, SEGMENT, "logits", "ph66", AlignConfig(blank_id=66, silence_anchors=4, ensure_completeness=True))


@query
def free_decode(spark, d):
    return _aligned(spark, d, "greedy").select("seg", "pos", "label", "start_frame", "end_frame")


@query
def alignment_score(spark, d):
    """Sum of the log-probabilities along the greedy path."""
    f = _frames(spark, d).withColumn("lp", C.log_softmax(F.col("l")))
    return f.groupBy("seg").agg(F.round(F.sum(F.array_max("lp")), 4).alias("score"))


@query
def ctc_paths(spark, d):
    t = _targets(spark, d).withColumn("stride", C.ctc_stride(F.col("targets"), F.lit(LENGTH)))
    t = t.select("seg", "stride", F.posexplode(C.ctc_path(F.col("targets"), F.col("stride"), BLANK)).alias("pos", "label"))
    return t.select("seg", "pos", "label", C.band_width(F.lit(33)).cast("bigint").alias("band"))


# --- events: per user a sequence by time


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")


def _rle(spark, d):
    return islands.run_table(_events(spark, d), ["user_id"], F.to_date("ts"), ["ts", "event_id"], F.col("event_type"))


@query
def label_runs_rle(spark, d):
    return _rle(spark, d).select("user_id", "run", "value", "n")


@query
def rle_expand(spark, d):
    return islands.expanded_runs(_rle(spark, d), ["user_id"])


@query
def hop_windows(spark, d):
    w = islands.hopping(_events(spark, d), ["user_id"], F.to_date("ts"), ["ts", "event_id"], 8, 4)
    return w.groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("idx").alias("first_idx"))


@query
def rms_normalise(spark, d):
    """Vectors as the samples of short clips."""
    e = table(spark, d, "embeddings").select("vec_id", C.rms_normalised(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    return e.select("vec_id", F.posexplode("x").alias("pos", "value")).withColumn("value", F.round("value", 5))


def _quiet(spark, d):
    n = islands.indexed(_events(spark, d), ["user_id"], F.to_date("ts"), ["ts", "event_id"])
    return n.select("user_id", "idx", F.exp(-F.col("value") / 50).alias("p"))


@query
def silence_runs(spark, d):
    return islands.silences(_quiet(spark, d), ["user_id"], "idx", F.col("p"), 5, 0.5)


@query
def silence_backoff(spark, d):
    q = _quiet(spark, d).withColumn("targets", F.when(F.col("user_id") % 2 == 0, 300).otherwise(100))
    return islands.silence_ladder(q, ["user_id"], "idx", F.col("p"), 5, "targets")


@query
def session_like(spark, d):
    s = sessions.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), "n")


@query
def mel_spectra(spark, d):
    """The samples of a clip are stood in for by the values of a user's day, a bounded group."""
    e = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    e = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("key"), F.transform("x", lambda x: x["value"]).alias("samples"))
    return signal.mel_frames(e, "key", "samples", n_fft=8, hop=2, n_mels=4, rate=16_000, high=8_000.0)


@query
def dynamic_range(spark, d):
    e = _events(spark, d)
    c = C.compressed(F.col("value"))
    return e.select("event_id", F.round(c, 5).alias("compressed"), F.round(C.decompressed(c), 5).alias("restored"))


# --- clips: lengths in samples


@query
def frame_count_rule(spark, d):
    c = table(spark, d, "clips").where("wav_len IS NOT NULL AND sample_rate > 0")
    n = F.floor(F.col("wav_len") * 16000.0 / F.col("sample_rate"))
    layers = [(15, 7, 7), (11, 5, 5), (7, 3, 3), (5, 2, 2)]
    return c.select(
        "clip_id", F.unix_micros("ingested_at").alias("ingested_us"), C.frame_count(n, 1920, 1280, 10).alias("frames"), C.frame_count_legacy(n, 1920, 1280, 10).alias("legacy_frames"),
        C.layer_size(n, layers).cast("bigint").alias("layer_out"), F.lit(C.receptive_field(layers)).alias("field"),
    )


@query
def preset_resolve(spark, d):
    model, lang = presets.resolved(F.col("preset"), F.col("lang"))
    c = table(spark, d, "clips").select("clip_id", F.unix_micros("ingested_at").alias("ingested_us"), model.alias("model"), lang.alias("lang"))
    return c.withColumn("tokeniser", text.language(F.col("lang")))


@query
def chop_codes(spark, d):
    s = table(spark, d, "segments").where("start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND abs(start_s) < double('infinity') AND abs(end_s) < double('infinity')")
    return s.select("seg_uid", C.chop_code(F.col("start_s"), F.col("end_s"), F.lit(480_000)).alias("code"))


# --- segments and their phonemes


def _segments(spark, d, *columns):
    """Each segment's last delivery, with the columns that are asked for; only these are read and shuffled."""
    cols = dict.fromkeys(["seg_uid", *SEGMENT, *columns, "loaded_at"])
    return coverage.latest(table(spark, d, "segments").select(*cols), SEGMENT, ["loaded_at", "seg_uid"])


def _phonemes(spark, d):
    return table(spark, d, "phoneme_ts")


VALID = "start_ms IS NOT NULL AND end_ms IS NOT NULL AND NOT isnan(start_ms) AND NOT isnan(end_ms) AND end_ms > start_ms AND start_ms > double('-infinity') AND end_ms < double('infinity')"


@query
def id_lookup_default(spark, d):
    p = coverage.decoded(_phonemes(spark, d).select("row_id", "phoneme_id"), table(spark, d, "alphabet"))
    return p.select("row_id", "label", "group_id")


@query
def ipa_by_position(spark, d):
    s = _segments(spark, d, "ipa").select(*SEGMENT, "ipa")
    idx = F.col("target_seq_idx")
    label = F.when(idx >= 0, F.try_element_at("ipa", idx + 1))
    return _phonemes(spark, d).select("row_id", *SEGMENT, "target_seq_idx").join(s, SEGMENT).select("row_id", F.coalesce(label, F.lit("overflow")).alias("ipa"))


@query
def group_map(spark, d):
    t = coverage.decoded(coverage.targets(_segments(spark, d, "ph66")), table(spark, d, "alphabet"))
    return t.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_counts(spark, d):
    c = coverage.target_counts(coverage.targets(_segments(spark, d, "ph66")), _phonemes(spark, d))
    return c.select(*SEGMENT, "target_idx", "n")


@query
def invalid_targets(spark, d):
    return coverage.invalid_rows(coverage.targets(_segments(spark, d, "ph66")), _phonemes(spark, d).where("target_seq_idx IS NOT NULL")).select("row_id")


@query
def coverage_sets(spark, d):
    """Sets of ids are bounded by the alphabet and unknown ids, not by the rows of a segment."""
    a = _phonemes(spark, d).where("phoneme_id IS NOT NULL").groupBy(*SEGMENT).agg(F.collect_set("phoneme_id").alias("ids"))
    s = _segments(spark, d, "ph66").where("ph66 IS NOT NULL").select(*SEGMENT, "ph66").join(a, SEGMENT).withColumn("c", C.coverage(F.col("ph66"), F.col("ids")))
    return s.select(*SEGMENT, *(f"c.{x}" for x in ("target_count", "aligned_count", "missing_count", "extra_count")), F.round("c.coverage_ratio", 5).alias("coverage_ratio"), "c.bad_alignment")


def _once(spark, d):
    """One stretch of 16 ms frames for each target."""
    p = _phonemes(spark, d).where(VALID).where("target_seq_idx >= 0").withColumn("target_idx", F.col("target_seq_idx"))
    frame = lambda c: F.floor(F.col(c) / 16)
    return coverage.longest_per_target(p, [*SEGMENT, "target_idx"], frame("start_ms"), frame("end_ms") + 1)


@query
def merge_repeats(spark, d):
    return _once(spark, d)


@query
def missing_gap_fill(spark, d):
    return coverage.estimated(coverage.targets(_segments(spark, d, "ph66")), _once(spark, d))


@query
def sequence_match(spark, d):
    """Whether the aligned ids are the targets, by comparing position by position."""
    a = islands.indexed(_phonemes(spark, d).where(VALID), SEGMENT, F.floor(F.col("start_ms") / coverage.PIECE_MS), ["start_ms", "row_id"])
    a = a.select(*SEGMENT, F.col("phoneme_id").alias("got"), F.col("idx").cast("int").alias("target_idx"))
    t = coverage.targets(_segments(spark, d, "ph66")).select(*SEGMENT, "target_idx", F.col("phoneme_id").alias("want"))
    j = t.join(a, [*SEGMENT, "target_idx"], "full_outer")
    return j.groupBy(*SEGMENT).agg(F.min(F.col("got").eqNullSafe(F.col("want")).cast("int")).alias("same"))


@query
def confidence_qa(spark, d):
    p = _phonemes(spark, d).where(VALID).where("confidence IS NOT NULL AND NOT isnan(confidence)")
    c = coverage.confidence_report(p)
    return c.select(*SEGMENT, "phones", *(F.round(x, 5).alias(x) for x in ("weak", "early", "late")), "bad")


def _word_rows(spark, d):
    p = _phonemes(spark, d).where(VALID).where("confidence IS NOT NULL AND NOT isnan(confidence) AND target_seq_idx >= 0")
    s = _segments(spark, d, "word_num").select(*SEGMENT, "word_num")
    return p.join(s, SEGMENT).withColumn("w", F.try_element_at("word_num", F.col("target_seq_idx") + 1)).where("w IS NOT NULL")


@query
def word_rollup(spark, d):
    w = coverage.word_spans(_word_rows(spark, d), SEGMENT, ["start_ms", "row_id"], F.col("w"))
    return w.select(*SEGMENT, "run", "word", "start_ms", "end_ms", F.round("confidence", 9).alias("confidence"), "phones")


@query
def word_rollup_legacy(spark, d):
    return coverage.word_spans(_word_rows(spark, d), SEGMENT, ["start_ms", "row_id"], F.col("w"), legacy=True).select(*SEGMENT, "run", "word", "phones")


@query
def rollup_hierarchy(spark, d):
    p = _phonemes(spark, d).where(VALID)
    return p.rollup("clip_id", "seg_idx").agg(F.count(F.lit(1)).alias("phones"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")), 6).alias("ms"), F.sum(F.col("is_estimated").cast("int")).alias("estimated"), F.grouping_id().cast("int").alias("level"))


@query
def segment_totals(spark, d):
    p = _phonemes(spark, d).where(VALID).where("confidence BETWEEN 0 AND 1")
    return p.agg(F.count(F.lit(1)).alias("phones"), F.countDistinct("clip_id").alias("clips"), F.round(F.avg("confidence"), 5).alias("confidence"), F.round(F.max("end_ms") / 1000, 3).alias("xmax"))


@query
def clip_regroup(spark, d):
    """Texts of a clip in order; a clip's segments are bounded by its length in time."""
    s = _segments(spark, d, "text").groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("x")))).alias("s"))
    return s.select("clip_id", F.size("s").cast("bigint").alias("n"), F.array_join(F.transform("s", lambda x: x["x"]), " | ").alias("text"))


@query
def json_envelope(spark, d):
    """A clip's document written as JSON and read again."""
    s = _segments(spark, d, "text", "start_s", "end_s").where("text IS NOT NULL").groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"))).alias("segments"))
    j = s.select("clip_id", F.to_json(F.struct("segments")).alias("j")).select("clip_id", F.from_json("j", transcripts.SCHEMA)["segments"].alias("segments"))
    f = j.select("clip_id", F.filter("segments", lambda x: x["start"].isNotNull() & x["end"].isNotNull()).alias("segments"))
    return transcripts.flattened(f, "clip_id").select("clip_id", F.col("seg_idx").alias("pos"), "text")


@query
def validate_reject(spark, d):
    s = table(spark, d, "segments").select("seg_uid", F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text")).alias("segments"), F.coalesce(F.size("ph66"), F.lit(0)).alias("n"))
    why = F.coalesce(transcripts.rejected(s), F.when(F.col("n") < 1, "no targets"))
    return s.select("seg_uid", why.alias("why")).where("why IS NOT NULL")


@query
def unpaired_clips(spark, d):
    return transcripts.unpaired(table(spark, d, "segments"), table(spark, d, "clips"), "clip_id")


def _raster(spark, d):
    return raster.rasterised(_phonemes(spark, d), SEGMENT, F.col("start_ms"), F.col("end_ms"), F.col("phoneme_id"), ["row_id"], 20.0)


@query
def raster_frames(spark, d):
    return _raster(spark, d)


@query
def raster_gap_contract(spark, d):
    return raster.closed(_raster(spark, d), SEGMENT, 2)


def _grid_rows(spark, d):
    p = _phonemes(spark, d).where(VALID).where("phoneme_label IS NOT NULL")
    phones = p.select(*SEGMENT, F.lit(1).alias("tier_no"), F.lit("phonemes").alias("tier"), F.col("row_id").alias("k"), (F.col("start_ms") / 1000).alias("xmin"), (F.col("end_ms") / 1000).alias("xmax"), F.col("phoneme_label").alias("text"))
    w = coverage.word_spans(_word_rows(spark, d), SEGMENT, ["start_ms", "row_id"], F.col("w"))
    words = w.select(*SEGMENT, F.lit(2).alias("tier_no"), F.lit("words").alias("tier"), F.col("run").alias("k"), (F.col("start_ms") / 1000).alias("xmin"), (F.col("end_ms") / 1000).alias("xmax"), F.col("word").cast("string").alias("text"))
    return phones.unionByName(words)


@query
def textgrid_text(spark, d):
    return sinks.text_grids(_grid_rows(spark, d), SEGMENT, "tier_no", "tier", ["xmin", "k"])


@query
def textgrid_labels(spark, d):
    p = _phonemes(spark, d).where(VALID).where("confidence BETWEEN 0 AND 1 AND phoneme_label IS NOT NULL")
    return p.select("row_id", sinks.interval_label(F.col("phoneme_label"), F.col("confidence")).alias("text"), sinks.confidence_band(F.col("confidence")).alias("band"))


@query
def annotation_table(spark, d):
    """What a plot of a segment draws: boundary frames of 16 ms, labels and colour bands."""
    p = _phonemes(spark, d).where(VALID).where("confidence BETWEEN 0 AND 1").withColumnRenamed("phoneme_label", "label")
    return sinks.annotations(p, ["row_id"], 16.0).select("row_id", "frame", "label", "band")


@query
def silence_match(spark, d):
    """Pauses of a text, by their places among its tokens, with all quiet stretches of a user; in order, each the nearest.

    A user's recording is stood in for by the events and its text by that of a segment: user 0 has the first one's, and so on.
    """
    quiet = islands.silences(_quiet(spark, d), ["user_id"], "idx", F.col("p"), 5, 0.5)
    n = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    t = _texts(spark, d).select((F.col("seg_uid") - 1).alias("user_id"), F.transform(text.words_alpha(F.col("text")), lambda x: x == text.SIL).alias("pauses")).join(n, "user_id")
    return decoding.match_silences(t, quiet, ["user_id"], "pauses", F.col("n"))


@query
def label_maintenance(spark, d):
    """Labels by falling frequency, whether the alphabet has them, and their place in a new index."""
    return coverage.label_index(_phonemes(spark, d), "phoneme_label", table(spark, d, "alphabet").select("phoneme_label"))


@query
def label_duplicates(spark, d):
    """Labels of each sound group against its distinct spellings."""
    return coverage.duplicate_labels(table(spark, d, "alphabet"), "ipa_label", "group_id")


@query
def collapse_labels(spark, d):
    """Labels that are in no alphabet, collapsed to one phone."""
    rows = table(spark, d, "alphabet").select("phoneme_label").orderBy("phoneme_id").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"the alphabet has more than {MOST_LABELS} labels")
    known = F.array(*(F.lit(r.phoneme_label) for r in rows))
    p = _phonemes(spark, d).where("ipa_label IS NOT NULL").select("ipa_label").distinct()
    return p.where(~F.array_contains(known, F.col("ipa_label"))).select("ipa_label", text.collapsed(F.col("ipa_label"), known).alias("phone"))


# --- texts


def _texts(spark, d):
    return table(spark, d, "segments").where("text IS NOT NULL").select("seg_uid", "text")


@query
def tokenise(spark, d):
    return _texts(spark, d).select("seg_uid", F.posexplode(text.words_alpha(F.col("text"))).alias("pos", "token"))


@query
def tokenise_unspaced(spark, d):
    return _texts(spark, d).select("seg_uid", F.posexplode(text.words_unspaced(F.col("text"))).alias("pos", "token"))


@query
def tokenise_spaced(spark, d):
    return _texts(spark, d).select("seg_uid", F.posexplode(text.words_spaced(F.col("text"))).alias("pos", "token"))


@query
def vocab_stats(spark, d):
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id").select(F.explode(text.words_alpha(F.col("text"))).alias("token"))
    return text.vocabulary_stats(docs, "token")


@query
def sil_groups(spark, d):
    """Runs of pauses in tokenised texts."""
    t = _texts(spark, d).select("seg_uid", F.posexplode(text.words_alpha(F.col("text"))).alias("pos", "token"))
    n = islands.numbered(t, ["seg_uid"], F.floor(F.col("pos") / 65_536), ["pos"], F.col("token") == text.SIL).where(F.col("token") == text.SIL)
    return n.groupBy("seg_uid", "run").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos")).drop("run")


@query
def word_reindex(spark, d):
    """Words that are no pauses, numbered densely."""
    t = _texts(spark, d).select("seg_uid", F.posexplode(text.words_alpha(F.col("text"))).alias("pos", "token"))
    return text.reindexed_words(t, ["seg_uid"], "pos", F.col("token") != text.SIL).select("seg_uid", "token", F.col("word_num").cast("bigint").alias("word_num"))


@query
def compound_split(spark, d):
    labels = _phonemes(spark, d).where("ipa_label IS NOT NULL").select("ipa_label")
    return text.compound_splits(labels, "ipa_label", table(spark, d, "alphabet").select("phoneme_label"))


@query
def pronounce(spark, d):
    """Phones of every word by the stand-in pronunciation."""
    t = _texts(spark, d).select("seg_uid", text.words_alpha(F.col("text")).alias("words"))
    return models.pronounced(t, ["seg_uid"], "words")


@query
def tokenise_by_language(spark, d):
    """Each text by the tokeniser of one of five languages in turn."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "hi", "zh-CN", "de", "ar"))), (F.col("seg_uid") % 5 + 1).cast("int"))
    return _texts(spark, d).select("seg_uid", F.posexplode(text.tokens(F.col("text"), lang)).alias("pos", "token"))


@query
def ipa_normalise(spark, d):
    """Distinct labels with their canonical form."""
    labels = _phonemes(spark, d).where("ipa_label IS NOT NULL").select("ipa_label").distinct()
    return labels.select("ipa_label", text.normalised(F.col("ipa_label")).alias("form"))


def _phones(spark, d):
    return table(spark, d, "alphabet").select("phoneme_label")


def _spellings(spark, d):
    """The agreed spellings as a mapping to the alphabet's labels."""
    return table(spark, d, "alphabet").select(F.col("ipa_label").alias("label"), F.array("phoneme_label").alias("phones"))


@query
def label_mapping(spark, d):
    """What each distinct spelling stands for, and by which way."""
    m = text.mapped_labels(_phonemes(spark, d), "ipa_label", _spellings(spark, d), _phones(spark, d))
    return m.select("ipa_label", F.array_join("phones", " ").alias("phones"), "way")


@query
def phone_expansion(spark, d):
    """Each row's spelling as phones of the alphabet, noise left out."""
    rows = _phonemes(spark, d).where("ipa_label IS NOT NULL").select("row_id", "ipa_label")
    return text.expanded_phones(rows, "ipa_label", _spellings(spark, d), _phones(spark, d)).select("row_id", "part", "mapped", "ipa")


@query
def mapping_faults(spark, d):
    """The labels that rows have for each spelling, as a mapping that should be single-valued and closed."""
    m = _phonemes(spark, d).where("ipa_label IS NOT NULL AND phoneme_label IS NOT NULL").select("ipa_label", "phoneme_label").distinct()
    return text.mapping_faults(m, _phones(spark, d), "ipa_label", "phoneme_label")


def _documents_of_rows(spark, d):
    """Documents of the rows that are there, in place of an alignment."""
    p = _phonemes(spark, d).where(VALID).where("confidence IS NOT NULL AND NOT isnan(confidence) AND phoneme_id IS NOT NULL")
    s = _segments(spark, d, "text", "start_s", "end_s", "ph66", "pg16", "ipa", "words", "word_num").where("ph66 IS NOT NULL")
    a = p.join(s.select(*SEGMENT, "word_num"), SEGMENT)
    word = F.when(F.col("target_seq_idx") >= 0, F.try_element_at("word_num", F.col("target_seq_idx") + 1))
    a = a.select(
        *SEGMENT, F.lit(None).cast("string").alias("error"), F.col("ph_index").alias("pos"), "phoneme_id", F.col("phoneme_label").alias("label"), "ipa_label", word.alias("word"),
        "start_ms", "end_ms", "confidence", "is_estimated", F.col("target_seq_idx").alias("target_idx"),
    )
    return pipeline.segment_documents(a, s, table(spark, d, "alphabet"))


@query
def segment_documents(spark, d):
    """Sizes of each segment's document."""
    g = _documents_of_rows(spark, d)
    c = F.col("coverage_analysis")
    return g.select(
        *SEGMENT, F.size("phoneme_ts").alias("phones"), F.size("words_ts").alias("spans"), c["target_count"].alias("target_count"), c["aligned_count"].alias("aligned_count"), F.round(c["coverage_ratio"], 5).alias("coverage_ratio"),
        F.size(c["missing_phonemes"]).alias("missing"), F.size(c["extra_phonemes"]).alias("extra"), F.size(F.filter("phoneme_ts", lambda x: x["confidence"] > 0.5)).alias("confident"),
    )


@query
def large_windows(spark, d):
    """Windows of vectors as of utterances: 40 samples, 5 apart."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(C.large_windows(F.col("embedding"), 1000, 40, 5)).alias("w", "x"))
    return e.select("vec_id", "w", F.round(F.element_at("x", 1).cast("double"), 5).alias("first"), F.size("x").alias("n"))


@query
def alignment_totals(spark, d):
    a = _phonemes(spark, d).where(VALID).where("confidence BETWEEN 0 AND 1").withColumn("error", F.lit(None).cast("string"))
    return pipeline.totals(a).select("segments", "failed", "phonemes", "estimated", F.round("confidence", 5).alias("confidence"), F.round("ms", 4).alias("ms"))
