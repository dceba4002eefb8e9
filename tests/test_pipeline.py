"""The whole way from sound and text to documents, with the stand-in model."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.cli import main
from spandrel.config import AlignConfig
from spandrel.operators import signal, text
from spandrel.plans import pipeline as P
from spandrel.sources import audio, models, sinks
from tests.test_operators import ALPHABET, wav

ALL = [*ALPHABET, (66, "noise", "noise", 16), (23, "aɪ", "aɪ", 5)]


@pytest.fixture(scope="module")
def alphabet(spark):
    return spark.createDataFrame(ALL, "phoneme_id int, phoneme_label string, ipa_label string, group_id int")


@pytest.fixture(scope="module")
def clips(spark):
    x = (np.random.default_rng(1).normal(size=32_000) * 0.1).tolist()
    return spark.createDataFrame([("a", x), ("b", x[:16_000]), ("tiny", x[:1_000])], "clip_id string, samples array<double>")


@pytest.fixture(scope="module")
def segments(spark):
    rows = [("a", 0, 0.0, 1.0, "hello world."), ("a", 1, 1.0, 2.0, "hello"), ("b", 0, 0.0, 1.0, "wow ~ hello"), ("tiny", 0, 0.0, 0.0625, "wow")]
    return spark.createDataFrame(rows, "clip_id string, seg_idx int, start_s double, end_s double, text string")


def test_phonemised(spark, segments, alphabet):
    got = {(r.clip_id, r.seg_idx): r for r in P.phonemised(segments, alphabet, "en-us").collect()}
    r = got["a", 0]
    assert r.words == ["hello", "world", "<sil>"] and r.word_num == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert r.mipa == ["h", "ɛ", "l", "l", "ɑ", "w", "ɑ", "ɹ", "l", "d", "SIL"] and r.ipa == r.mipa and r.pg16[0] == 8 and len(r.ph66) == len(r.pg16) == 11
    assert got["b", 0].words == ["wow", "hello"]  # a word without phones is left out
    mapping = spark.createDataFrame([("w", ["h", "noise", "d"]), ("ɑ", ["xx", "l"])], P.NO_MAPPING)
    only = alphabet.where("phoneme_label NOT IN ('w', 'ɑ')")
    r = next(x for x in P.phonemised(segments, only, "en-us", mapping=mapping).collect() if x.clip_id == "tiny")
    assert (r.mipa, r.ipa, r.words) == (["h", "d", "l", "h", "d"], ["w", "-", "-", "w", "-"], ["wow"])
    kept = next(x for x in P.phonemised(segments, only, "en-us", mapping=mapping, keep_noise=True).collect() if x.clip_id == "tiny")
    assert kept.mipa == ["h", "noise", "d", "noise", "l", "h", "noise", "d"]


def test_documents(spark, clips, segments, alphabet):
    cfg = AlignConfig(ensure_completeness=True)
    rows = P.align(clips, segments, alphabet, cfg, groups=True, vectors=True).cache()
    assert {(r.clip_id, r.seg_idx) for r in rows.collect()} == {("a", 0), ("a", 1), ("b", 0), ("tiny", 0)}
    docs = {(r.clip_id, r.seg_idx): r for r in P.segment_documents(rows, P.phonemised(segments, alphabet, cfg.lang), alphabet).collect()}
    d = docs["a", 0]
    assert [p.phoneme_label for p in d.phoneme_ts] == ["h", "ɛ", "l", "l", "ɑ", "w", "ɑ", "ɹ", "l", "d", "SIL"]
    assert [p["index"] for p in d.phoneme_ts] == list(range(11)) and all(a.start_ms <= b.start_ms for a, b in zip(d.phoneme_ts, d.phoneme_ts[1:]))
    assert [w.word for w in d.words_ts] == ["hello", "world", "<sil>"] and d.words_ts[0].ph66 == d.ph66[:5] and d.words_ts[1].end_ms == d.phoneme_ts[9].end_ms
    assert d.words_ts[0].confidence == pytest.approx(np.mean([p.confidence for p in d.phoneme_ts[:5]]))
    c = d.coverage_analysis
    assert (c.target_count, c.aligned_count, c.missing_phonemes, c.bad_alignment) == (8, 8, [], False) and c.coverage_ratio == 1.0
    assert len(d.group_ts) > 0 and all(0 <= g.group_id <= 16 for g in d.group_ts)
    vectors = rows.where("track = 'phoneme' AND clip_id = 'a'").select("vector").collect()
    assert all(len(v.vector) == 16 for v in vectors)
    t = P.totals(rows).first()
    assert (t.segments, t.failed) == (4, 0) and t.phonemes == sum(len(x.phoneme_ts) for x in docs.values())
    grids = {(g.clip_id, g.seg_idx): g.grid for g in sinks.document_grids(P.segment_documents(rows, P.phonemised(segments, alphabet, cfg.lang), alphabet), P.SEGMENT, True).collect()}
    assert '"groups"' in grids["a", 0] and '"words"' in grids["a", 0] and 'text = "h (' in grids["a", 0]
    rows.unpersist()


def test_pooled_vectors_equal_numpy(spark, alphabet):
    x = np.random.default_rng(3).normal(size=16_000)
    clips = spark.createDataFrame([("c", x.tolist())], "clip_id string, samples array<double>")
    seg = spark.createDataFrame([("c", 0, 0.0, 1.0, "hello")], "clip_id string, seg_idx int, start_s double, end_s double, text string")
    s = P.ready(clips, seg, alphabet, vectors=True).first()
    lp = np.asarray(s.classes) - np.log(np.exp(np.asarray(s.classes)).sum(axis=1, keepdims=True))
    frame = 1000 / len(s.classes)
    for r in P.align(clips, seg, alphabet, vectors=True).collect():
        a, b = round(r.start_ms / frame), round(r.end_ms / frame)
        w = np.exp(lp[a:b, r.phoneme_id])
        assert r.vector == pytest.approx(((np.asarray(s.vectors)[a:b] * w[:, None]).sum(axis=0) / w.sum()).tolist(), rel=1e-6)


def test_command_line(spark, alphabet, tmp_path, capsys):
    x = (np.random.default_rng(2).normal(size=16_000) * 3000).astype(int)
    (tmp_path / "x.wav").write_bytes(wav(x))
    alphabet.write.parquet(str(tmp_path / "alphabet"))
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"start": 0.0, "end": 1.0, "text": "hello world."}]}))
    for given in ("hello world.", str(tmp_path / "t.json")):
        out = str(tmp_path / "out")
        assert main([str(tmp_path / "x.wav"), given, str(tmp_path / "alphabet"), out, "--groups", "--textgrid", str(tmp_path / "grid"), "--embeddings", str(tmp_path / "emb")]) == 0
        assert "1 segment(s)" in capsys.readouterr().out
        (line,) = [r.value for r in spark.read.text(out).collect()]
        (seg,) = json.loads(line)["segments"]
        assert {"start", "end", "text", "ph66", "pg16", "ipa", "word_num", "words", "coverage_analysis", "phoneme_ts", "words_ts", "group_ts"} <= set(seg)
        assert {"index", "phoneme_id", "phoneme_label", "ipa_label", "start_ms", "end_ms", "confidence", "is_estimated", "target_seq_idx"} == set(seg["phoneme_ts"][0])
        assert os.path.exists(tmp_path / "grid") and spark.read.parquet(str(tmp_path / "emb")).where("track = 'phoneme'").count() == len(seg["phoneme_ts"])


def test_a_tone_keeps_its_pitch():
    t = np.arange(8_000) / 8_000
    for target in (16_000, 11_025, 4_000):
        y = signal.band_limited(np.sin(2 * np.pi * 440 * t), 8_000, target)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / target)
        assert len(y) == target and np.abs(y - want)[200:-200].max() < 2e-3
    high = signal.band_limited(np.sin(2 * np.pi * 3_500 * t), 8_000, 4_000)
    assert np.abs(high[200:-200]).max() < 1e-2 and len(signal.band_limited(np.zeros(0), 8_000, 16_000)) == 0


def test_clips_in_memory(spark):
    x = np.ones(160)
    one = lambda g: [(r.clip_id, len(r.samples)) for r in audio.clips_of(spark, g, 16_000).collect()]
    assert one(x) == [("0", 160)] and one(np.ones((2, 160))) == [("0", 160)] and one(np.ones((3, 1, 160))) == [("0", 160), ("1", 160), ("2", 160)]
    assert one([x, x[:80]]) == [("0", 160), ("1", 80)] and one({"a": x, "b": np.zeros((1, 0))}) == [("a", 160), ("b", 0)]
    with pytest.raises(ValueError):
        audio.clips_of(spark, x)
    clips = audio.clips_of(spark, {"a": x, "b": x}, 16_000)
    with pytest.raises(ValueError, match="mismatch"):
        audio.paired(clips, clips.limit(1).select("clip_id"))
    assert audio.paired(clips, clips.select("clip_id", F.lit(1).alias("t"))).count() == 2


def test_mapped_labels(spark, rows):
    phones = spark.createDataFrame([("t",), ("ʃ",), ("ə",), ("l",), ("a:",), (None,)], "p string")
    mapping = spark.createDataFrame([("q", ["t", "l"])], P.NO_MAPPING)
    labels = spark.createDataFrame([("t",), ("q",), ("tʃ",), ("tʃəl",), ("7a:8l",), ("9",), (None,), ("t",)], "x string")
    got = rows(text.mapped_labels(labels, "x", mapping, phones))
    assert got == sorted([("t", ["t"], "direct"), ("q", ["t", "l"], "compound"), ("tʃ", ["t", "ʃ"], "split"), ("tʃəl", ["t", "ʃ", "ə", "l"], "greedy"), ("7a:8l", ["a:", "l"], "greedy"), ("9", ["noise"], "noise")], key=str)


def test_normalised_and_tokens_by_language(spark):
    assert spark.createDataFrame([("  ã ",), (None,), ("b",)], "x string").select(text.normalised(F.col("x")).alias("y")).collect() == [("ã",), (None,), ("b",)]
    df = spark.createDataFrame([("hi", "क ख।"), ("zh-CN", "中文。"), ("en", "it's so."), ("pap", "a b.")], "lang string, t string")
    got = {r.lang: r.x for r in df.select("lang", text.tokens(F.col("t"), F.col("lang")).alias("x")).collect()}
    assert got == {"hi": ["क", "ख", "<SIL>", "<SIL>"], "zh-CN": ["中", "文", "<SIL>", "<SIL>"], "en": ["it", "s", "so", "<SIL>"], "pap": ["a", "b", "<SIL>"]}


def test_mapping_faults(spark, rows):
    m = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("x", "e"), ("x", "f"), ("e", "e")], "label string, phone string")
    known = spark.createDataFrame([(p,) for p in "abde"], "p string")
    assert rows(text.mapping_faults(m, known)) == sorted([("a", "cycle"), ("b", "cycle"), ("c", "chain"), ("x", "repeated"), ("x", "unknown")], key=str)


def test_windows_cover_all_samples():
    x = np.arange(1.0, 11.0)
    assert models.padded_windows(x, 4, 3).tolist() == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]
    assert models.padded_windows(x[:2], 4, 3).tolist() == [[1, 2, 0, 0]] and models.padded_windows(x[:5], 4, 3).tolist() == [[1, 2, 3, 4], [4, 5, 0, 0]]


def test_stitching_equals_overlap_add(spark):
    from spandrel.operators import frames

    scores = np.random.default_rng(4).normal(size=(7, 10, 3))
    df = spark.createDataFrame([(0, w, x.tolist()) for w, x in enumerate(scores)], "k int, w int, f array<array<double>>")
    long = {(r.t, r.cls): r.value for r in frames.overlap_added(df, ["k"], "w", F.col("f"), 10).collect()}
    short = frames.stitched(scores)
    assert len(long) == short.size and all(short[t, c] == pytest.approx(v, abs=1e-9) for (t, c), v in long.items())


def tiny_network(path):
    """A network file with one node that hands its input on, byte by byte."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    number = lambda field, n: varint(field << 3) + varint(n)
    part = lambda field, body: varint(field << 3 | 2) + varint(len(body)) + body
    shape = part(2, part(1, part(2, b"n")) + part(1, part(2, b"f")) + part(1, part(2, b"c")))
    value = lambda name: part(1, name) + part(2, part(1, number(1, 1) + shape))
    node = part(1, b"audio_window") + part(2, b"phoneme_logits") + part(4, b"Identity")
    graph = part(1, node) + part(2, b"g") + part(11, value(b"audio_window")) + part(12, value(b"phoneme_logits"))
    path.write_bytes(number(1, 8) + part(7, graph) + part(8, part(1, b"") + number(2, 13)))


def test_exported_network(tmp_path):
    tiny_network(tmp_path / "m.onnx")
    x = np.random.default_rng(5).normal(size=(3, 10, 4)).astype(np.float32)
    model = models.onnx_model(str(tmp_path / "m.onnx"))
    assert (model(x) == x).all()
    assert models.difference(model, models.onnx_model(str(tmp_path / "m.onnx"), {"classes": "phoneme_logits"}), x) == 0.0
    with pytest.raises(ValueError, match="heads"):
        models.difference(model, lambda w: {"other": w}, x)
