import json

import pytest

from pyspark.sql import functions as F

from spandrel.operators import nested as N

SEG = {"text": "a", "words": ["x", None, "y"], "phoneme_ts": [{"phoneme_label": "p", "c": 1}, None, {"phoneme_label": None}], "coverage_analysis": {"missing_phonemes": ["m"], "extra_phonemes": []}}
PAYLOADS = [
    json.dumps({"segments": [SEG, SEG]}),
    "﻿" + json.dumps([{"segments": [SEG]}, {"x": {"segments": {**SEG, "words": "solo"}}}]),
    json.dumps({"a": {"b": {"segments": json.dumps([{**SEG, "phoneme_ts": json.dumps(SEG["phoneme_ts"][0]), "words": '["é"]', "coverage_analysis": json.dumps({"missing_phonemes": "one"})}])}}}),
    json.dumps({"segments": [{"phoneme_ts": "null", "words": None}]}),
    json.dumps({"segments": [SEG]})[:-3],
    json.dumps({"segments": [SEG]}) + " x",
    "", None, "7", '"text"', "[]", "{}",
]
TABLES = ["phoneme_ts", "words", "missing_phonemes", "extra_phonemes"]


def frame(spark, payloads=PAYLOADS):
    return spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "record_id bigint, payload string, item string")


def test_children(spark, rows):
    df = frame(spark)
    levels = N.array_levels(N.merged_schema(df, "payload"))
    assert levels["segments"] is False and all(levels[t] for t in TABLES)
    s = N.shred(df, "record_id", "payload", levels, TABLES, item_fields={"phoneme_ts": "phoneme_label"}, row_keys=False)
    got = rows(s.select("record_id", "parent_pos", "tbl", "ord", "item"))
    one = lambda r, p: [(r, p, "words", 0, "x"), (r, p, "words", 2, "y"), (r, p, "phoneme_ts", 0, "p"), (r, p, "phoneme_ts", 2, None), (r, p, "missing_phonemes", 0, "m")]
    want = one(0, 0) + one(0, 1) + one(1, 0) + [x for x in one(1, 1) if x[2] != "words"] + [(1, 1, "words", 0, "solo")]
    want += [(2, 0, "phoneme_ts", 0, "p"), (2, 0, "words", 0, "é"), (2, 0, "missing_phonemes", 0, "one")]
    assert got == sorted(want, key=str)


def test_keys_link_and_tables_are_flat(spark, rows):
    df = frame(spark)
    long = N.shred(df, "record_id", "payload", N.array_levels(N.merged_schema(df, "payload")))
    seg = N.flat_table(long, "segments", {"text": "string"})
    words = N.flat_table(long, "words", {"item": "string"})
    parents = seg.select(F.col("record_id"), F.col("row_key").alias("parent_key"))
    assert words.select("record_id", "parent_key").join(parents, ["record_id", "parent_key"], "left_anti").count() == 0
    keys = long.select("record_id", "row_key")
    assert keys.distinct().count() == keys.count()
    assert rows(seg.where("record_id = 1").select("pos", "text")) == [(0, "a"), (1, "a")]


def test_merged_schema_counts_records(spark):
    got = {r.path: (r.kinds, r.records) for r in N.merged_schema(frame(spark), "payload").collect()}
    assert got["$"] == (["array", "object"], 6)
    assert got["$.segments.[].words.[]"][1] == 1


def test_empty(spark, rows):
    df = frame(spark, [])
    assert N.array_levels(N.merged_schema(df, "payload")) == {}
    assert rows(N.shred(df, "record_id", "payload", {"a": True})) == []


def test_deep_nesting_is_refused_not_fatal(spark, rows):
    deep = "[" * 100_000 + "]" * 100_000
    assert rows(N.shred(frame(spark, [deep]), "record_id", "payload", {"a": True})) == []


def test_keys_with_dots(spark, rows):
    df = frame(spark, [json.dumps({"a.b": [{"c.d": ["x", "y"]}, {"c.d": "z"}]})])
    levels = N.array_levels(N.merged_schema(df, "payload"))
    assert levels == {"a.b": False, "c.d": True}
    s = N.shred(df, "record_id", "payload", levels, ["c.d"])
    assert rows(s.select("parent_pos", "ord", "pos", "item")) == [(0, 0, 0, "x"), (0, 1, 1, "y"), (1, 0, 2, "z")]


def test_half_characters_and_deep_records(spark, rows):
    deep = '{"a":' * 3000 + '{"words": ["x"]}' + "}" * 3000
    df = frame(spark, ['{"words": ["\\ud800", "y"], "\\udc00": [1]}', deep])
    levels = N.array_levels(N.merged_schema(df, "payload"))
    s = N.shred(df, "record_id", "payload", levels, ["words"])
    assert rows(s.select("record_id", "ord", "item")) == [(0, 0, "?"), (0, 1, "y"), (1, 0, "x")]


def test_parents_are_named(spark, rows):
    df = frame(spark, [json.dumps({"words": ["top"], "clips": [{"words": ["clip"], "segments": [{"words": ["seg"]}]}]})])
    levels = N.array_levels(N.merged_schema(df, "payload"))
    s = N.shred(df, "record_id", "payload", levels, ["words"], row_keys=False)
    assert rows(s.select("parent_tbl", "item")) == [("", "top"), ("clips", "clip"), ("segments", "seg")]


@pytest.mark.parametrize("text", ['[1, {"a": [], "b": {}}, -2.5e3, "x\\\\u00e9", null, true]', " {} ", '"x"', "3", "[NaN]"])
def test_parser_with_a_stack(text):
    assert repr(N.deep(text)) == repr(json.loads(text))


@pytest.mark.parametrize("text", ["", "[", "[1,]", "{1: 2}", '{"a" 1}', '{"a": 1,}', "[1] 2", "[1 2]", "tru", '["x]'])
def test_parser_with_a_stack_refuses(text):
    with pytest.raises(ValueError):
        N.deep(text)


def test_deeper_than_the_plain_parser_goes(spark, rows):
    n = 9_000
    got = rows(N.shred(frame(spark, ['{"a":' * n + '{"words": ["x"]}' + "}" * n]), "record_id", "payload", {"words": True}).select("tbl", "ord", "item"))
    assert got == [("words", 0, "x")]
