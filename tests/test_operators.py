import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.cli import main
from spandrel.config import AlignConfig
from spandrel.operators import coverage, islands, raster, text
from spandrel.plans.pipeline import align, align_sentence
from spandrel.sources import audio, presets, sinks, transcripts
from spandrel.streaming import sessions


def test_numbered_across_slices(spark, rows):
    import random

    r = random.Random(1)
    data = [(r.choice(["a", None]), i, r.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v string")
    got = {(x.k, x.i): (x.idx, x.run) for x in islands.numbered(df, ["k"], F.floor(F.col("i") / 7), ["i"], F.col("v")).collect()}
    for k in ("a", None):
        own = [(i, v) for kk, i, v in data if kk == k]
        run = 0
        for n, (i, v) in enumerate(own):
            run += n > 0 and v != own[n - 1][1]
            assert got[k, i] == (n, run)


def test_raster_gaps(spark, rows):
    df = spark.createDataFrame([("a", 0.0, 20.0, 1, 1), ("a", 200.0, 220.0, 2, 2), ("a", None, 5.0, 3, 3)], "k string, s double, e double, l int, r int")
    frames = raster.rasterised(df, ["k"], F.col("s"), F.col("e"), F.col("l"), ["r"], 20.0)
    assert [x[1:] for x in sorted(rows(frames), key=lambda x: x[1])] == [(0, 1), (1, 1), (9, 2), (10, 2)]
    closed = {x[1]: x[2] for x in rows(raster.closed(frames, ["k"], 2))}
    assert [closed.get(i) for i in range(11)] == [1, 1, 1, 1, None, None, None, 2, 2, 2, 2]


def test_words_golden(spark):
    nums = [0, 0, 1, 1, 1, 1, *[2] * 12, *[3] * 5, 4]
    df = spark.createDataFrame([("c", 0, i, float(i), i + 1.0, 0.5, w) for i, w in enumerate(nums)], "clip_id string, seg_idx int, row_id int, start_ms double, end_ms double, confidence double, w int")
    w = coverage.word_spans(df, ["clip_id", "seg_idx"], ["start_ms"], F.col("w"))
    assert [(r.start_ms, r.end_ms, r.phones) for r in w.orderBy("run").collect()] == [(0, 2, 2), (2, 6, 4), (6, 18, 12), (18, 23, 5), (23, 24, 1)]
    assert coverage.word_spans(df, ["clip_id", "seg_idx"], ["start_ms"], F.col("w"), legacy=True).count() == 4


def test_tokenisers(spark):
    t = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first().x
    assert t(text.words_alpha, "Héllo, it's_1.") == ["Héllo", "<SIL>", "it", "s_1", "<SIL>"]
    assert t(text.words_unspaced, "你好。<SIL>a,") == ["你", "好", "<SIL>", "<SIL>", "<SIL>", "a", "<SIL>"]
    assert t(text.words_spaced, ",नमस्ते! a;b <SIL> ;") == ["<SIL>", "नमस्ते", "<SIL>", "<SIL>", "a;b", "<SIL>", "<SIL>", "<SIL>"]
    assert t(text.words_alpha, "") == [] and t(text.words_alpha, None) is None


@pytest.mark.parametrize("preset,lang,want", [("en-us", "en-us", ("english", "en-us")), ("de", None, ("european8", "de")), ("hi", "en-us", ("universal", "hi")), ("de", "en-gb", ("european8", "en-gb")), (None, None, ("english", "en-us")), ("xx-unknown", None, ("universal", "xx-unknown"))])
def test_presets(spark, preset, lang, want):
    m, ln = presets.resolved(F.col("p"), F.col("l"))
    assert tuple(spark.createDataFrame([(preset, lang)], "p string, l string").select(m, ln).first()) == want


def test_transcripts(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('{"segments":[{"start":0.0,"end":2.0,"text":"hello world","more":1}]}')
    (tmp_path / "b.json").write_text('{"other":1}')
    (tmp_path / "c.json").write_text('{"segments":[{"start":0.0}]}')
    (tmp_path / "d.json").write_text('{"segments":[]}')
    df = transcripts.read_json(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([a-z])\\.json$", 1))
    assert rows(df.select("name", transcripts.rejected(df))) == [("a", None), ("b", "missing 'segments' key"), ("c", "missing required keys"), ("d", None)]
    assert rows(transcripts.flattened(df, "name")) == [("a", 0, 0.0, 2.0, "hello world")]


def test_text_grid(spark):
    df = spark.createDataFrame([(1, 1, "phonemes", 0.0, 0.5, "b"), (1, 1, "phonemes", 0.5, 1.0, 'q"'), (1, 2, "words", 0.0, 1.0, "w")], "k int, no int, tier string, xmin double, xmax double, text string")
    grid = sinks.text_grids(df, ["k"], "no", "tier", ["xmin"]).first().grid
    assert grid.startswith('File type = "ooTextFile"\nObject class = "TextGrid"') and "size = 2\nitem []:" in grid and 'text = "q"""' in grid
    assert grid.index('"phonemes"') < grid.index('"words"') and "intervals: size = 2" in grid


def wav(samples, rate=16_000):
    import struct

    body = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -32768], 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = {r.path[-5:]: r for r in audio.read_wav(spark, str(tmp_path), 8000).collect()}
    assert got["a.wav"].samples == [0.0, 0.5, -1.0] and got["b.wav"].error


ALPHABET = [(0, "SIL", "SIL", 0), (46, "h", "h", 8), (7, "ɛ", "ɛ", 3), (56, "l", "l", 13), (18, "ɑ", "ɑ", 6), (62, "w", "w", 12), (59, "ɹ", "ɹ", 14), (31, "d", "d", 7)]


def test_pipeline(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=32_000) * 0.1).astype(float).tolist()
    clips = spark.createDataFrame([("c", x, "hello world."), ("short", x[:100], "hello")], "clip_id string, samples array<double>, text string")
    alphabet = spark.createDataFrame(ALPHABET, "phoneme_id int, phoneme_label string, ipa_label string, group_id int")
    rows = align_sentence(clips, alphabet).orderBy("pos").collect()
    assert {r.clip_id for r in rows} == {"c"} and all(r.error is None and r.end_ms >= r.start_ms for r in rows)
    assert [r.label for r in rows] == ["h", "ɛ", "l", "l", "ɑ", "w", "ɑ", "ɹ", "l", "d", "SIL"]
    seg = spark.createDataFrame([("c", 0, 0.0, 1.0, "hello"), ("c", 1, 1.0, 2.0, "world"), ("c", 2, 1.0, 1.01, "world"), ("none", 0, 0.0, 1.0, "hello")], "clip_id string, seg_idx int, start_s double, end_s double, text string")
    rows = align(clips, seg, alphabet, AlignConfig(), mode="simple").collect()
    assert {(r.clip_id, r.seg_idx) for r in rows} == {("c", 0), ("c", 1)} and all(r.start_ms >= 1000 for r in rows if r.seg_idx == 1)


def test_cli(tmp_path, capsys):
    assert main(["--list-presets"]) == 0 and "en-us" in capsys.readouterr().out
    assert main([str(tmp_path / "missing.wav"), "hello", "x"]) != 0
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0


def test_sessions_stream(spark, rows, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0), (1, t0 + dt.timedelta(minutes=10)), (1, t0 + dt.timedelta(hours=3)), (2, t0), (2, t0 + dt.timedelta(days=2))]
    spark.createDataFrame(data, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted((r.k, r.n) for r in sessions.sessions(batch, "k", "ts").collect()) == [(1, 1), (1, 2), (2, 1), (2, 1)]
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, "k", "ts").writeStream.format("memory").queryName("s").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n) for r in spark.table("s").collect()} <= {(1, 1), (1, 2), (2, 1)}


def test_keep_states_stream(spark, rows, tmp_path):
    from spandrel.operators.intervals import combine_states, covered_periods

    data = [("a", 0, 0.0, 10.0), ("a", 0, 5.0, 20.0), ("a", 0, 30.0, 31.0)]
    ddl = "clip_id string, seg_idx int, start_ms double, end_ms double"
    for i, r in enumerate(data):
        spark.createDataFrame([r], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = ["clip_id", "seg_idx"]
    sessions.keep_states(stream, str(tmp_path / "out"), keys, "start_ms", "end_ms", str(tmp_path / "ck")).awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out")).select(*keys, "slice", "starts", "ends")
    assert rows(covered_periods(combine_states(kept, keys), keys)) == [("a", 0, 0, 20_000), ("a", 0, 30_000, 31_000)]


def test_intervals_of_any_length_are_kept(spark):
    from pyspark.sql import functions as F

    from spandrel.operators import raster
    from spandrel.plans.catalogue import VALID

    data = [(1, 0.0, 120_000.0), (2, 0.0, float("inf")), (3, float("-inf"), 5.0), (4, 5.0, 5.0), (5, None, 5.0), (6, 0.0, float("nan"))]
    df = spark.createDataFrame(data, "row_id int, start_ms double, end_ms double")
    assert [r.row_id for r in df.where(VALID).collect()] == [1]
    got = raster.rasterised(df.withColumn("k", F.lit(0)), ["k"], F.col("start_ms"), F.col("end_ms"), F.col("row_id"), ["row_id"], 20.0)
    assert sorted((r.frame, r.label) for r in got.collect()) == [(f, 1) for f in range(6_000)]
