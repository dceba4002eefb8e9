"""Every registered query with SQL against DuckDB on the smallest data, if it is there."""

import os

import pytest

import __spark_entry__ as e
from spandrel.plans import problems
from spandrel.plans.catalogue_sql import SQL

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_entry(spark):
    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_queries_equal_sql():
    import selfcheck

    assert selfcheck.main(D, *(SQL | problems.oracle_sql())) == 0


def _json(v):
    """What a text says, if it is a JSON array or object."""
    import json

    if isinstance(v, str) and v.lstrip("﻿ ")[:1] in ("[", "{"):
        try:
            return json.loads(v.lstrip("﻿ "))
        except ValueError:
            return v
    return None if v == "null" else v


def _many(v):
    v = _json(v)
    return [] if v is None else v if isinstance(v, list) else [v]


def _segments(v):
    v = _json(v)
    for x in v if isinstance(v, list) else []:
        yield from _segments(x)
    for k, x in v.items() if isinstance(v, dict) else []:
        if k == "segments":
            yield from _many(x)
        else:
            yield from _segments(x)


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_nested_records_against_a_plain_walk(spark):
    import json

    want = set()
    for r in spark.read.parquet(f"{D}/vs_records.parquet").collect():
        try:
            value = json.loads((r.payload or "").lstrip("﻿"))
        except ValueError:
            continue
        for pos, seg in enumerate(_segments(value)):
            if seg is None:
                continue
            seg = _json(seg)
            about = _json(seg.get("coverage_analysis")) or {}
            for child in ("phoneme_ts", "words", "missing_phonemes", "extra_phonemes"):
                for k, x in enumerate(_many((about if "_phonemes" in child else seg).get(child))):
                    if x is not None:
                        x = _json(x) if child == "phoneme_ts" else x
                        want.add((r.record_id, pos, child, k, x["phoneme_label"] if child == "phoneme_ts" else x))
    got = [tuple(x) for x in e.queries()["p5_found"](spark, D).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_silence_match_against_brute_force(spark):
    import math
    import re
    from collections import defaultdict

    from spandrel.operators.decoding import matched

    values = defaultdict(list)
    for r in spark.read.parquet(f"{D}/events.parquet").collect():
        values[r.user_id].append((r.ts, r.event_id, math.exp(-r.value / 50)))
    texts = {r.seg_uid - 1: r.text for r in spark.read.parquet(f"{D}/segments.parquet").collect() if r.text is not None}
    stretches = lambda flags: [(a, b) for a in range(len(flags)) for b in range(a + 1, len(flags) + 1) if all(flags[a:b]) and not (a and flags[a - 1]) and not (b < len(flags) and flags[b])]
    want, crowded = set(), False
    for user, rows in values.items():
        p = [x for *_, x in sorted(rows)]
        on = stretches([sum(p[i : i + 5]) / 5 >= 0.5 for i in range(len(p) - 4)])
        quiet = [(a, len(p) if b == len(p) - 4 else b + 4) for a, b in on]
        crowded |= len({round((a + b) / 2 / len(p), 1) for a, b in quiet}) < len(quiet)
        tokens = re.findall(r"\w+|[.,!?;:]", texts.get(user, ""))
        pauses = stretches([t in tuple(".,!?;:") for t in tokens])
        want |= {(user, g, s) for g, s in (matched(pauses, quiet, len(tokens), len(p)) if tokens else [])}
    assert crowded and want
    got = [tuple(r) for r in e.queries()["silence_match"](spark, D).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_too_large_an_alphabet_is_refused(spark, tmp_path):
    from spandrel.plans import catalogue

    spark.range(10_001).selectExpr("id AS phoneme_id", "concat('x', id) AS phoneme_label").write.parquet(f"{tmp_path}/alphabet.parquet")
    spark.createDataFrame([("a",)], "ipa_label string").write.parquet(f"{tmp_path}/phoneme_ts.parquet")
    with pytest.raises(ValueError, match="more than 10000"):
        catalogue.collapse_labels(spark, str(tmp_path))


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
def test_texts_are_aligned_in_order(spark):
    from collections import defaultdict

    from pyspark.sql import functions as F

    rows = defaultdict(list)
    for r in e.queries()["forced_align_texts"](spark, D).where("error IS NULL").collect():
        rows[r.clip_id, r.seg_idx].append(r)
    n = {(r.clip_id, r.seg_idx): r.n for r in spark.read.parquet(f"{D}/segments.parquet").groupBy("clip_id", "seg_idx").agg(F.max_by(F.size("ph66"), F.struct("loaded_at", "seg_uid")).alias("n")).collect()}
    assert len(rows) > 50
    for key, own in rows.items():
        own.sort(key=lambda r: r.pos)
        assert all(0 <= r.target_idx < n[key] and r.start_frame < r.end_frame for r in own)
        assert all(a.start_frame <= b.start_frame for a, b in zip(own, own[1:]))
        assert len({r.target_idx for r in own}) == len(own)
