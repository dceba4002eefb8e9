"""The aligner's plan: clips and transcripts to labelled, scored intervals and documents of them.  Lazy; one shuffle key, (clip_id, seg_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.config import AlignConfig
from spandrel.functions import columns as C
from spandrel.operators import coverage, decoding, text
from spandrel.sources import models, transcripts

SEGMENT = ["clip_id", "seg_idx"]
#: No table of compounds.
NO_MAPPING = "label STRING, phones ARRAY<STRING>"


def phonemised(segments: DataFrame, alphabet: DataFrame, lang: str, clip: str = "clip_id", mapping: DataFrame | None = None, keep_noise: bool = False) -> DataFrame:
    """segments with ph66, pg16, ipa, mipa, word_num and words of their text, arrays of equal length but for words.

    Phones are mapped by ``text.expanded_phones``; words without a phone are left out and the others
    numbered anew.  A segment's phones are bounded by its text; they are gathered in their order.
    Segments without a phone are left out.
    """
    s = segments.withColumn("_w", text.tokens(F.col("text"), F.lit(lang)))
    p = models.pronounced(s, [clip, "seg_idx"], "_w")
    mapping = s.sparkSession.createDataFrame([], NO_MAPPING) if mapping is None else mapping
    p = text.expanded_phones(p, "phone", mapping, alphabet.select("phoneme_label"), keep_noise)
    names = alphabet.select(F.col("phoneme_label").alias("mapped"), "phoneme_id", "group_id")
    p = p.join(names, "mapped").withColumn("_n", F.dense_rank().over(Window.partitionBy(clip, "seg_idx").orderBy("word_idx")) - 1)
    word = F.when(F.col("word") == text.SIL, "<sil>").otherwise(F.trim("word"))
    row = F.struct("word_idx", "phone_idx", "part", "phoneme_id", "group_id", "ipa", "mapped", F.col("_n").cast("int").alias("_n"), word.alias("word"))
    g = p.groupBy(clip, "seg_idx").agg(F.array_sort(F.collect_list(row)).alias("_p"))
    first = F.filter("_p", lambda x, i: (i == 0) | (F.element_at("_p", F.greatest(i, F.lit(1)))["_n"] != x["_n"]))
    g = g.select(
        clip, "seg_idx", F.col("_p.phoneme_id").alias("ph66"), F.col("_p.group_id").alias("pg16"), F.col("_p.ipa").alias("ipa"), F.col("_p.mapped").alias("mipa"),
        F.col("_p._n").alias("word_num"), F.transform(first, lambda x: x["word"]).alias("words"),
    )
    return s.drop("_w").join(g, [clip, "seg_idx"])


def align(
    clips: DataFrame, segments: DataFrame, alphabet: DataFrame, cfg: AlignConfig | None = None, model: models.Model | None = None, mode: str = "full",
    mapping: DataFrame | None = None, groups: bool = False, vectors: bool = False,
) -> DataFrame:
    """A row per aligned phoneme: clip_id, seg_idx, error, pos, phoneme_id, label, group_id, ipa_label, word, start_ms, end_ms, confidence, is_estimated, target_idx.

    clips: clip_id, samples ARRAY<FLOAT> at the configured rate.  segments: clip_id, seg_idx, start_s,
    end_s, text.  Segments that are too short, have no phones or no clip give no rows; those that
    can't be aligned give one row with an error.  pos counts from 0 in the order of start_ms.

    groups: also rows of the group track, aligned by the model's head for groups; a column track tells
    'phoneme' from 'group'.  vectors: a column vector, the mean by score of the model's vectors over
    each row's frames.
    """
    out = _aligned(ready(clips, segments, alphabet, cfg, model, mapping, groups, vectors), alphabet, cfg or AlignConfig(), mode, groups, vectors)
    return out if groups else out.drop("track")


def ready(clips, segments, alphabet, cfg=None, model=None, mapping=None, groups=False, vectors=False) -> DataFrame:
    """A row per usable segment: its text's phones, wav_len and the model's scores by frame."""
    cfg, model = cfg or AlignConfig(), model or models.stand_in_model(groups=17 if groups else 0, dims=16 if vectors else 0)
    rate = cfg.sample_rate
    window, stride = cfg.window_ms * rate // 1000, cfg.stride_ms * rate // 1000
    s = phonemised(segments, alphabet, cfg.lang, mapping=mapping).where(F.size("ph66") >= cfg.min_targets).join(clips.select("clip_id", "samples"), "clip_id")
    s = s.withColumn("code", C.chop_code(F.col("start_s"), F.col("end_s"), F.size("samples"), rate, int(cfg.min_segment_s * rate))).where("code = 0")
    s = s.withColumn("wav", C.chopped(F.col("samples"), F.col("start_s"), F.col("end_s"), rate, cfg.duration_max_s)).drop("samples", "code")
    s = s.withColumn("wav_len", F.size("wav"))
    heads = (models.CLASSES, *[models.GROUPS] * groups, *[models.VECTORS] * vectors)
    cols = [*SEGMENT, "start_s", "wav_len", "ph66", "pg16", "ipa", "word_num"]
    s = models.predicted(s, cols, "wav", model, window, stride, heads).withColumn("_keep", C.frame_count(F.col("wav_len"), window, stride, 10).cast("int"))
    for head in heads:  # without the frames that only filled-up samples have
        s = s.withColumn(head, F.when(F.col("_keep") < F.size(head), F.slice(head, F.lit(1), F.col("_keep"))).otherwise(F.col(head)))
    return s.drop("_keep")


def _aligned(s: DataFrame, alphabet: DataFrame, cfg: AlignConfig, mode: str, groups: bool, vectors: bool) -> DataFrame:
    keys = [*SEGMENT, "start_s", "wav_len", "_t"]
    s = s.withColumn("_t", F.size(models.CLASSES))
    pool = models.VECTORS if vectors else None

    def track(name: str, head: str, targets: str, own: AlignConfig) -> DataFrame:
        found = decoding.align_segments(s, keys, head, targets, own, mode, {"ipa_label": "ipa", "word": "word_num"}, pool).withColumn("track", F.lit(name))
        ms = lambda c: F.col("start_s") * 1000 + C.frame_ms(F.col(c), F.col("wav_len"), F.col("_t"), own.sample_rate)
        return found.withColumn("start_ms", ms("start_frame")).withColumn("end_ms", ms("end_frame"))

    cols = [*SEGMENT, "track", "error", "pos", "phoneme_id", "label", "group_id", "ipa_label", "word", "start_ms", "end_ms", "confidence", "is_estimated", "target_idx", *["vector"] * vectors]
    phones = track("phoneme", models.CLASSES, "ph66", cfg).withColumnRenamed("label", "phoneme_id").withColumn("ipa_label", F.coalesce("ipa_label", F.lit("overflow")))
    rows = coverage.decoded(phones, alphabet).select(*cols)
    if not groups:
        return rows
    names = alphabet.select(F.col("group_id").alias("_g")).distinct()
    g = track("group", models.GROUPS, "pg16", cfg.for_groups()).withColumnRenamed("label", "group_id").join(names, F.col("group_id") == F.col("_g"), "left")
    label = F.concat(F.when(F.col("_g").isNull(), "UNK_").otherwise("group_"), F.col("group_id").cast("string"))
    g = g.withColumn("label", label).withColumn("phoneme_id", F.lit(None).cast("int")).withColumn("ipa_label", F.lit(None).cast("string"))
    return rows.unionByName(g.select(*cols))


def align_sentence(clips: DataFrame, alphabet: DataFrame, cfg: AlignConfig | None = None, model: models.Model | None = None, **more) -> DataFrame:
    """As ``align`` for clips with their own text: clip_id, samples, text."""
    cfg = cfg or AlignConfig()
    whole = transcripts.sentence_envelope(clips, F.size("samples"), F.col("text"), cfg.sample_rate)
    return align(clips, transcripts.flattened(whole, "clip_id"), alphabet, cfg, model, **more)


def segment_documents(aligned: DataFrame, segments: DataFrame, alphabet: DataFrame) -> DataFrame:
    """A row per segment, the fields of its document: start, end, text, ph66, pg16, ipa, words, word_num, coverage_analysis, phoneme_ts, words_ts and, where there is a group track, group_ts.

    aligned: rows of ``align``.  segments: rows of ``phonemised``.  Segments without aligned rows have
    empty lists.  A segment is bounded by the longest duration; words are gathered before segments.
    """
    rows = aligned.where("error IS NULL")
    tracks = "track" in aligned.columns
    p = rows.where("track = 'phoneme'") if tracks else rows
    ts = F.struct(
        F.col("pos").alias("index"), "phoneme_id", F.col("label").alias("phoneme_label"), "ipa_label", "start_ms", "end_ms", "confidence", "is_estimated", F.col("target_idx").alias("target_seq_idx")
    )
    w = p.groupBy(*SEGMENT, "word").agg(F.array_sort(F.collect_list(ts)).alias("_p"))
    of = lambda f: F.transform("_p", lambda x: x[f])
    span = F.when(
        F.col("word").isNotNull(),
        F.struct(
            F.element_at("_p", 1)["index"].alias("_i"), F.col("word").alias("word_num"), F.element_at("_p", 1)["start_ms"].alias("start_ms"), F.element_at("_p", -1)["end_ms"].alias("end_ms"),
            (C.total(of("confidence")) / F.size("_p")).alias("confidence"), of("phoneme_id").alias("ph66"), of("ipa_label").alias("ipa"),
        ),
    )
    g = w.groupBy(*SEGMENT).agg(F.array_sort(F.flatten(F.collect_list("_p"))).alias("phoneme_ts"), F.array_sort(F.collect_list(span)).alias("_w"))
    if tracks:
        gts = F.struct(F.col("pos").alias("index"), "group_id", F.col("label").alias("group_label"), "start_ms", "end_ms", "confidence", "is_estimated", F.col("target_idx").alias("target_seq_idx"))
        own = rows.where("track = 'group'").groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(gts)).alias("group_ts"))
        g = g.join(own, SEGMENT, "left")
    out = segments.join(g, SEGMENT, "left")
    label = F.create_map(*(F.lit(x) for r in _labels(alphabet) for x in r))
    named = lambda ids: F.transform(ids, lambda i: F.coalesce(label[i], F.concat(F.lit("UNK_"), i.cast("string"))))
    out = out.withColumn("_c", C.coverage(F.col("ph66"), F.coalesce(F.col("phoneme_ts.phoneme_id"), F.array().cast("array<int>"))))
    analysis = F.struct(
        *(f"_c.{x}" for x in ("target_count", "aligned_count", "missing_count", "extra_count", "coverage_ratio")),
        named(F.col("_c.missing_ids")).alias("missing_phonemes"), named(F.col("_c.extra_ids")).alias("extra_phonemes"), "_c.bad_alignment",
    )
    words = F.transform(
        "_w",
        lambda x: F.struct(
            F.coalesce(F.try_element_at("words", x["word_num"] + 1), F.concat(F.lit("UNK_WORD_"), x["word_num"].cast("string"))).alias("word"),
            x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["confidence"].alias("confidence"), x["ph66"].alias("ph66"), x["ipa"].alias("ipa"),
        ),
    )
    none = lambda c: F.coalesce(F.col(c), F.array().cast(g.schema[c].dataType))
    return out.select(
        *SEGMENT, F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "ph66", "pg16", "ipa", "word_num", "words",
        analysis.alias("coverage_analysis"), none("phoneme_ts").alias("phoneme_ts"), F.coalesce(words, F.array()).alias("words_ts"), *([none("group_ts").alias("group_ts")] if tracks else []),
    )


def _labels(alphabet: DataFrame) -> list[tuple[int, str]]:
    rows = alphabet.select("phoneme_id", "phoneme_label").where("phoneme_id IS NOT NULL").distinct().orderBy("phoneme_id").limit(text.MOST_PHONES + 1).collect()
    if len(rows) > text.MOST_PHONES:
        raise ValueError(f"more than {text.MOST_PHONES} phones")
    return [(r[0], r[1]) for r in rows]


def clip_documents(segments: DataFrame) -> DataFrame:
    """clip_id, segments: a clip's document of the rows of ``segment_documents``, in order; such a cell grows with its clip."""
    fields = F.struct("seg_idx", *(c for c in segments.columns if c not in SEGMENT))
    g = segments.groupBy("clip_id").agg(F.array_sort(F.collect_list(fields)).alias("segments"))
    return g.withColumn("segments", F.transform("segments", lambda x: x.dropFields("seg_idx")))


def totals(aligned: DataFrame) -> DataFrame:
    """One row: segments, failed segments, phonemes, estimated ones, their mean confidence and duration, over any number of runs."""
    p = aligned.where("track = 'phoneme'") if "track" in aligned.columns else aligned
    good = F.col("error").isNull()
    return p.agg(
        F.countDistinct(*SEGMENT).alias("segments"), F.sum((~good).cast("long")).alias("failed"), F.sum(good.cast("long")).alias("phonemes"), F.sum(F.when(good, F.col("is_estimated").cast("long"))).alias("estimated"),
        F.avg("confidence").alias("confidence"), F.avg(F.col("end_ms") - F.col("start_ms")).alias("ms"),
    )
