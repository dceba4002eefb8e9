"""python -m spandrel.cli AUDIO TEXT_OR_JSON ALPHABET OUT: aligns WAV files with a text or a transcript."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spandrel import __version__
from spandrel.config import AlignConfig
from spandrel.plans.pipeline import align, clip_documents, phonemised, segment_documents, totals
from spandrel.session import local_session, settled
from spandrel.sources import audio, presets, sinks, transcripts


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("spandrel")
    p.add_argument("audio", nargs="?")
    p.add_argument("text", nargs="?", help="a transcript's JSON file, or the text itself")
    p.add_argument("alphabet", nargs="?", help="Parquet table of phonemes")
    p.add_argument("out", nargs="?", help="folder of the JSON documents; AUDIO.vs.json if left out")
    p.add_argument("--textgrid", help="folder for text grids")
    p.add_argument("--embeddings", help="folder for vectors of phonemes")
    p.add_argument("--groups", action="store_true", help="also the group track")
    p.add_argument("--mode", choices=("full", "simple"), default="full")
    p.add_argument("--preset", default="en-us")
    p.add_argument("--lang", default="en-us")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--list-presets", action="store_true")
    a = p.parse_args(argv)
    if a.list_presets:
        print("english:", *presets.ENGLISH)
        print("european8:", *presets.EUROPEAN)
        return 0
    if not a.audio or not a.text or not a.alphabet or not os.path.exists(a.audio):
        print("an audio file, a text and an alphabet are needed", file=sys.stderr)
        return 2
    spark = SparkSession.getActiveSession() or local_session()
    clips = audio.read_wav(spark, a.audio).where("error IS NULL").withColumn("clip_id", F.lit(os.path.basename(a.audio)))
    if os.path.isfile(a.text):
        whole = transcripts.read_json(spark, a.text).withColumn("clip_id", F.lit(os.path.basename(a.audio)))
    else:
        whole = transcripts.sentence_envelope(clips, F.size("samples"), F.lit(a.text))
    lang = a.preset if a.lang == presets.DEFAULT_LANG else a.lang
    cfg, alphabet = AlignConfig(preset=a.preset, lang=lang), spark.read.parquet(a.alphabet)
    segments = transcripts.flattened(whole, "clip_id")
    aligned = settled(align(clips, segments, alphabet, cfg, mode=a.mode, groups=a.groups, vectors=bool(a.embeddings)))
    documents = segment_documents(aligned, phonemised(segments, alphabet, cfg.lang), alphabet)
    out = a.out or f"{a.audio}.vs.json"
    sinks.write_json(clip_documents(documents).select("segments"), out)
    if a.textgrid:
        sinks.write_grids(sinks.document_grids(documents, ["clip_id", "seg_idx"]), a.textgrid)
    if a.embeddings:
        sinks.write_embeddings(aligned, a.embeddings)
    t = totals(aligned).first()
    print(f"{t.segments} segment(s), {t.phonemes or 0} phoneme(s), {t.failed or 0} failed, mean confidence {t.confidence or 0:.3f} -> {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
