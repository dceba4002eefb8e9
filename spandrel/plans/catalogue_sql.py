"""DuckDB SQL for the queries of the catalogue that SQL can express."""

from __future__ import annotations

from spandrel.operators.text import ENDERS, PAUSES, _class
from spandrel.sources.models import GRAPHEMES

_FRAMES = """
f0 AS (SELECT vec_id, vec_id // 50 AS seg, vec_id % 50 AS t, label AS own, embedding, list_transform(embedding, lambda x: 20 * x::DOUBLE) AS l FROM embeddings),
f1 AS (SELECT *, list_max(l) AS mx FROM f0),
f2 AS (SELECT *, ln(list_sum(list_transform(l, lambda x: exp(x - mx)))) + mx AS z FROM f1),
frames AS (SELECT vec_id, seg, t, own, embedding, list_transform(l, lambda x: x - z) AS lp FROM f2),
targets AS (SELECT seg, list((own + 1)::INT ORDER BY t) AS tg FROM f0 WHERE t < 8 GROUP BY seg)
"""
_GREEDY = (
    "WITH "
    + _FRAMES
    + """,
g AS (SELECT seg, t, embedding, (list_position(lp, list_max(lp)) - 1)::INT AS label, exp(list_max(lp)) AS p FROM frames),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY seg ORDER BY t) <> label THEN 1 ELSE 0 END AS new FROM g),
n AS (SELECT *, sum(new) OVER (PARTITION BY seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT * FROM n WHERE label <> 63),
runs AS (SELECT seg, run, min(label) AS label, min(t) AS start_frame, max(t) + 1 AS end_frame FROM r GROUP BY seg, run)
"""
)
_SEQ = """
WITH e AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AND idx > 0 THEN 1 ELSE 0 END AS new FROM e),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
"""


def _quiet(k: int, threshold: float, name: str, only: str = "true") -> str:
    return f"""
{name}_m AS (SELECT user_id, idx, len, avg(p) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS m FROM q WHERE {only}),
{name}_f AS (SELECT *, m >= {threshold} AS is_on FROM {name}_m WHERE idx <= len - {k}),
{name}_c AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM {name}_f WHERE is_on),
{name} AS (SELECT user_id, min(idx) AS start_idx, CASE WHEN max(idx) = max(len) - {k} THEN max(len) ELSE max(idx) + {k} END AS end_idx FROM {name}_c GROUP BY user_id, g)"""


_Q = "WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events), q AS (SELECT user_id, idx, exp(-value / 50) AS p, count(*) OVER (PARTITION BY user_id) AS len FROM e)"
_V = "start_ms IS NOT NULL AND end_ms IS NOT NULL AND NOT isnan(start_ms) AND NOT isnan(end_ms) AND end_ms > start_ms AND isfinite(start_ms) AND isfinite(end_ms)"
_LATEST = "s AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY clip_id, seg_idx ORDER BY loaded_at DESC NULLS LAST, seg_uid DESC) = 1)"
_TARGETS = _LATEST + ", tgt AS (SELECT clip_id, seg_idx, (generate_subscripts(ph66, 1) - 1)::INT AS target_idx, unnest(ph66) AS phoneme_id FROM s)"
_ONCE = f"""
v AS (SELECT clip_id, seg_idx, target_seq_idx AS target_idx, floor(start_ms / 16)::BIGINT AS st, floor(end_ms / 16)::BIGINT + 1 AS en FROM phoneme_ts WHERE {_V} AND target_seq_idx >= 0),
v1 AS (SELECT *, max(en) OVER (PARTITION BY clip_id, seg_idx, target_idx ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v),
v2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR st > pe THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, seg_idx, target_idx ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM v1),
v3 AS (SELECT clip_id, seg_idx, target_idx, g, min(st) AS st, max(en) AS en FROM v2 GROUP BY ALL),
once AS (SELECT clip_id, seg_idx, target_idx, st AS "start", en AS "end" FROM v3 QUALIFY row_number() OVER (PARTITION BY clip_id, seg_idx, target_idx ORDER BY en - st DESC, st) = 1)
"""
_WORDS = f"""
wr AS (SELECT p.*, s.word_num[p.target_seq_idx + 1] AS w FROM phoneme_ts p JOIN s USING (clip_id, seg_idx)
       WHERE {_V.replace("start_ms", "p.start_ms").replace("end_ms", "p.end_ms")} AND confidence IS NOT NULL AND NOT isnan(confidence) AND target_seq_idx >= 0),
w0 AS (SELECT * FROM wr WHERE w IS NOT NULL),
w1 AS (SELECT *, CASE WHEN lag(w) OVER o IS DISTINCT FROM w OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS new FROM w0 WINDOW o AS (PARTITION BY clip_id, seg_idx ORDER BY start_ms, row_id)),
w2 AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, seg_idx ORDER BY start_ms, row_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM w1),
words AS (SELECT clip_id, seg_idx, run::BIGINT AS run, min(w) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, avg(confidence) AS confidence, count(*) AS phones FROM w2 GROUP BY clip_id, seg_idx, run)
"""
_RASTER = """
r0 AS (SELECT clip_id, seg_idx, phoneme_id, row_id, start_ms AS s, end_ms AS e FROM phoneme_ts WHERE """ + _V + """),
r1 AS (SELECT *, min(s) OVER (PARTITION BY clip_id, seg_idx) AS s0, max(e) OVER (PARTITION BY clip_id, seg_idx) AS e1 FROM r0),
r2 AS (SELECT *, greatest(floor((s - s0) / 20.0)::BIGINT - 1, 0) AS lo, least(ceil((e - s0) / 20.0)::BIGINT + 1, ceil((e1 - s0) / 20.0)::BIGINT) AS hi FROM r1),
r3 AS (SELECT clip_id, seg_idx, unnest(range(lo, hi)) AS frame, s, row_id, phoneme_id FROM r2),
ras AS (SELECT clip_id, seg_idx, frame, phoneme_id AS label FROM r3 QUALIFY row_number() OVER (PARTITION BY clip_id, seg_idx, frame ORDER BY s, row_id) = 1)
"""
_TOKENS = "tok AS (SELECT seg_uid, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[.,!?;:]'), lambda x: CASE WHEN x IN ('.', ',', '!', '?', ';', ':') THEN '<SIL>' ELSE x END) AS t FROM segments WHERE text IS NOT NULL), toks AS (SELECT seg_uid, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM tok)"

_PRESETS = """CASE WHEN p IN ('en-us','en','en-gb','en-029','en-gb-x-gbclan','en-gb-x-rp','en-gb-scotland','en-gb-x-gbcwmd') THEN 'english'
  WHEN p IN ('de','fr','fr-be','fr-ch','es','es-419','it','pt','pt-br','pl','nl','da','sv','nb','is','cs','sk','sl','hr','bs','sr','mk','bg','ro','hu','et','lv','lt','ca','an','pap','ht','af','lb','ga','gd','cy') THEN 'european8'
  WHEN p <> '' THEN 'universal' END"""
_VOWELS = "('i','i:','ɨ','ɪ','e','e:','ɛ','ə','ɚ','ʌ','u','u:','ʊ','ɯ','o','o:','ɔ','a','a:','æ','y','ø')"


def _edges(weights: list[float]) -> str:
    return "[" + ", ".join(f"{w!r}::DOUBLE" for w in weights) + "]"


def _overlap() -> str:
    from spandrel.operators.frames import window_weights

    return f"""
WITH {_FRAMES},
x AS (SELECT seg, t AS w, unnest(range(0, 64)) AS i, unnest(l) AS v, count(*) OVER (PARTITION BY seg) AS nw FROM f0),
y AS (SELECT seg, w, i // 8 AS fr, (i % 8)::INT AS cls, v, nw FROM (SELECT seg, w, i, v, max(w) OVER (PARTITION BY seg) + 1 AS nw FROM x)),
z AS (SELECT seg, w * 4 + fr AS t, cls, v, nw, ({_edges(window_weights(8))})[fr + 1] AS wt FROM y)
SELECT seg, t, cls, round(sum(v * wt) / (sum(wt) + 1e-8), 4) AS value FROM z WHERE t < nw * 4 GROUP BY seg, t, cls"""


SQL: dict[str, str] = {
    "frame_log_softmax": f"WITH {_FRAMES} SELECT vec_id, (generate_subscripts(lp, 1) - 1)::INT AS cls, round(unnest(lp), 5) AS lp FROM frames",
    "target_boost_floor": f"""
WITH {_FRAMES},
b0 AS (SELECT vec_id, tg, list_transform(lp, lambda x, i: CASE WHEN list_contains(tg, (i - 1)::INT) AND i - 1 <> 63 THEN x + 5 ELSE x END) AS b FROM frames JOIN targets USING (seg)),
b1 AS (SELECT *, list_max(b) AS mx FROM b0),
b2 AS (SELECT *, ln(list_sum(list_transform(b, lambda x: exp(x - mx)))) + mx AS z FROM b1),
b3 AS (SELECT vec_id, tg, (generate_subscripts(b, 1) - 1)::INT AS cls, unnest(b) - z AS lp FROM b2)
SELECT vec_id, cls, round(CASE WHEN cls <> 63 THEN greatest(lp, ln(1e-8)) ELSE lp END, 5) AS lp FROM b3 WHERE list_contains(tg, cls)""",
    "greedy_decode_runs": _GREEDY + "SELECT seg, label, start_frame, end_frame FROM runs",
    "span_confidence": _GREEDY
    + """, a AS (SELECT seg, run, min(t) AS t0, arg_min(p, t) AS p0 FROM r GROUP BY seg, run),
b AS (SELECT seg, run, avg(CASE WHEN t = t0 OR p > p0 / 2 OR p > 0.1 THEN p END) AS m, max(p) AS top FROM r JOIN a USING (seg, run) GROUP BY seg, run)
SELECT seg, label, start_frame, round(CASE WHEN m < top / 2 THEN top ELSE m END, 5) AS confidence FROM runs JOIN b USING (seg, run)""",
    "frames_to_ms": _GREEDY + "SELECT seg, label, round(start_frame * (64000 / 16000.0 / 50) * 1000, 4)::DOUBLE AS start_ms, round(end_frame * (64000 / 16000.0 / 50) * 1000, 4)::DOUBLE AS end_ms FROM runs",
    "weighted_pool": _GREEDY
    + """, x AS (SELECT seg, run, p, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS v FROM r)
SELECT seg, run::BIGINT AS run, dim, round(sum(p * v) / sum(p), 5) AS value FROM x GROUP BY seg, run, dim""",
    "overlap_add": _overlap(),
    "viterbi_path": f"""
WITH RECURSIVE {_FRAMES},
path AS (SELECT seg, s, CASE WHEN s % 4 = 1 THEN tg[s // 4 + 1] ELSE 63 END AS label, CASE WHEN s % 4 = 1 THEN s // 4 ELSE -1 END AS target_idx
         FROM targets, (SELECT unnest(range(0, 33)) AS s)),
emit AS (SELECT f.seg, f.t, p.s, f.lp[p.label + 1] AS e, p.label, p.target_idx, lag(p.label, 2) OVER (PARTITION BY f.seg, f.t ORDER BY p.s) AS label2 FROM frames f JOIN path p USING (seg)),
dp AS (
  SELECT seg, t, s, e AS score, 0 AS step FROM emit WHERE t = 0 AND s < 2
  UNION ALL
  SELECT seg, t, s, score, step FROM (
    SELECT m.seg, m.t, m.s, d.score + m.e AS score, m.s - d.s AS step, row_number() OVER (PARTITION BY m.seg, m.t, m.s ORDER BY d.score DESC, m.s - d.s) AS k
    FROM dp d JOIN emit m ON m.seg = d.seg AND m.t = d.t + 1 AND (m.s = d.s OR m.s = d.s + 1 OR (m.s = d.s + 2 AND m.label <> m.label2))) WHERE k = 1),
back AS (
  SELECT seg, t, s FROM (SELECT seg, t, s, row_number() OVER (PARTITION BY seg ORDER BY s DESC) AS k FROM dp WHERE t = 49) WHERE k = 1
  UNION ALL
  SELECT d.seg, d.t - 1, d.s - d.step FROM back b JOIN dp d ON d.seg = b.seg AND d.t = b.t AND d.s = b.s WHERE d.t > 0),
st AS (SELECT b.seg, b.t, p.label, p.target_idx FROM (SELECT seg, t, s FROM back) b JOIN path p USING (seg, s)),
c AS (SELECT *, CASE WHEN lag(label) OVER o <> label OR lag(target_idx) OVER o <> target_idx THEN 1 ELSE 0 END AS new FROM st WINDOW o AS (PARTITION BY seg ORDER BY t)),
n AS (SELECT *, sum(new) OVER (PARTITION BY seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT seg, min(label)::INT AS label, min(t)::INT AS start_frame, (max(t) + 1)::INT AS end_frame, min(target_idx)::INT AS target_idx FROM n WHERE label <> 63 GROUP BY seg, run""",
    "free_decode": _GREEDY + "SELECT seg, (row_number() OVER (PARTITION BY seg ORDER BY start_frame) - 1)::INT AS pos, label, start_frame::INT AS start_frame, end_frame::INT AS end_frame FROM runs",
    "alignment_score": f"WITH {_FRAMES} SELECT seg, round(sum(list_max(lp)), 4) AS score FROM frames GROUP BY seg",
    "ctc_paths": f"WITH {_FRAMES} SELECT seg, 4 AS stride_, s AS pos FROM targets, (SELECT unnest(range(0, 33)) AS s)",
    "label_runs_rle": _SEQ + "SELECT user_id, run, min(event_type) AS value, count(*) AS n FROM n GROUP BY user_id, run",
    "rle_expand": _SEQ + "SELECT user_id, idx, event_type AS value FROM n",
    "hop_windows": """
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS len FROM events),
w AS (SELECT user_id, len, unnest(range(0, (len - 8) // 4 + 1)) AS w FROM (SELECT DISTINCT user_id, len FROM e WHERE len >= 8))
SELECT w.user_id, w.w, count(*) AS n, round(sum(e.value), 4) AS total, min(e.idx) AS first_idx FROM w JOIN e ON e.user_id = w.user_id AND e.idx BETWEEN w.w * 4 AND w.w * 4 + 7 GROUP BY w.user_id, w.w""",
    "rms_normalise": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS r FROM e),
u AS (SELECT vec_id, r, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM r)
SELECT vec_id, pos, round(CASE WHEN r > 0 THEN x / r ELSE x END, 5) AS value FROM u""",
    "silence_runs": _Q + "," + _quiet(5, 0.5, "a") + " SELECT user_id, start_idx, end_idx FROM a",
    "silence_backoff": _Q
    + ","
    + _quiet(5, 0.9, "a")
    + ","
    + _quiet(5, 0.55, "b", "user_id % 2 = 0")
    + ","
    + _quiet(3, 0.9, "c", "user_id % 2 = 0")
    + """,
u AS (SELECT *, 0 AS step FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)
SELECT user_id, start_idx, end_idx, step FROM u QUALIFY step = min(step) OVER (PARTITION BY user_id)""",
    "session_like": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM n GROUP BY user_id, g""",
    "dynamic_range": "SELECT event_id, round(ln(greatest(value, 1e-5)), 5) AS compressed, round(exp(ln(greatest(value, 1e-5))), 5) AS restored FROM events",
    "frame_count_rule": """
WITH c AS (SELECT clip_id, epoch_us(ingested_at) AS ingested_us, floor(wav_len * 16000.0::DOUBLE / sample_rate)::BIGINT AS n FROM clips WHERE wav_len IS NOT NULL AND sample_rate > 0),
f AS (SELECT *, CASE WHEN n <= 1920 THEN ceil(10.0::DOUBLE * n / 1920)::BIGINT ELSE floor(floor((n - 1920)::DOUBLE / 1280 + 1) * 10 / 2)::BIGINT END AS a, floor(floor((n - 1920)::DOUBLE / 1280 + 1) * 10 / 2)::BIGINT AS b,
  floor((n + 14 - 15)::DOUBLE / 7)::BIGINT + 1 AS l1 FROM c),
g AS (SELECT *, floor((l1 + 10 - 11)::DOUBLE / 5)::BIGINT + 1 AS l2 FROM f),
h AS (SELECT *, floor((l2 + 6 - 7)::DOUBLE / 3)::BIGINT + 1 AS l3 FROM g)
SELECT clip_id, ingested_us, CASE WHEN a >= 2 THEN a END AS frames, CASE WHEN b >= 2 THEN b END AS legacy_frames, floor((l3 + 4 - 5)::DOUBLE / 2)::BIGINT + 1 AS layer_out, 7 * (5 * (3 * 4 + 6) + 10) + 15 - 7 * 0 - 0 AS field_ FROM h""",
    "preset_resolve": f"""
WITH c AS (SELECT clip_id, epoch_us(ingested_at) AS ingested_us, coalesce(preset, 'en-us') AS p, coalesce(lang, 'en-us') AS l FROM clips),
r AS (SELECT clip_id, ingested_us, {_PRESETS} AS model, CASE WHEN l = 'en-us' THEN p ELSE l END AS lang FROM c)
SELECT clip_id, ingested_us, model, lang, CASE lang WHEN 'zh-CN' THEN 'cmn' WHEN 'fr' THEN 'fr-fr' WHEN 'en' THEN 'en-us' WHEN 'uk' THEN 'zle' WHEN 'sv-SE' THEN 'sv' WHEN 'ga-IE' THEN 'ga' WHEN 'cv' THEN 'cu' ELSE lang END AS tokeniser FROM r""",
    "chop_codes": """
WITH c AS (SELECT seg_uid, floor(start_s * 16000)::BIGINT AS a, floor(end_s * 16000)::BIGINT AS b FROM segments
  WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND isfinite(start_s) AND isfinite(end_s))
SELECT seg_uid, CASE WHEN b - a < 800 THEN -1 WHEN least(b, 480000) - a < 800 THEN -2 ELSE 0 END AS code FROM c""",
    "id_lookup_default": "SELECT row_id, coalesce(a.phoneme_label, 'UNK_' || p.phoneme_id) AS label, coalesce(a.group_id, 16) AS group_id FROM phoneme_ts p LEFT JOIN alphabet a USING (phoneme_id)",
    "ipa_by_position": f"WITH {_LATEST} SELECT row_id, coalesce(CASE WHEN target_seq_idx >= 0 THEN s.ipa[target_seq_idx + 1] END, 'overflow') AS ipa FROM phoneme_ts p JOIN s USING (clip_id, seg_idx)",
    "group_map": f"WITH {_TARGETS} SELECT coalesce(a.group_id, 16) AS group_id, count(*) AS n FROM tgt LEFT JOIN alphabet a USING (phoneme_id) GROUP BY 1",
    "coverage_counts": f"""
WITH {_TARGETS}, n AS (SELECT clip_id, seg_idx, target_seq_idx AS target_idx, count(*) AS n FROM phoneme_ts WHERE target_seq_idx >= 0 GROUP BY ALL)
SELECT clip_id, seg_idx, target_idx, coalesce(n.n, 0) AS n FROM tgt LEFT JOIN n USING (clip_id, seg_idx, target_idx)""",
    "invalid_targets": f"WITH {_TARGETS} SELECT row_id FROM phoneme_ts p WHERE target_seq_idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.clip_id = p.clip_id AND tgt.seg_idx = p.seg_idx AND tgt.target_idx = p.target_seq_idx)",
    "coverage_sets": f"""
WITH {_LATEST}, a AS (SELECT clip_id, seg_idx, list(DISTINCT phoneme_id) AS ids FROM phoneme_ts WHERE phoneme_id IS NOT NULL GROUP BY ALL),
b AS (SELECT clip_id, seg_idx, list_distinct(ph66) AS t, ids FROM s JOIN a USING (clip_id, seg_idx) WHERE ph66 IS NOT NULL),
c AS (SELECT *, len(list_intersect(t, ids)) AS k FROM b)
SELECT clip_id, seg_idx, len(t)::INT AS target_count, len(ids)::INT AS aligned_count, (len(t) - k)::INT AS missing_count, (len(ids) - k)::INT AS extra_count,
  round(CASE WHEN len(t) > 0 THEN k::DOUBLE / len(t) ELSE 1 END, 5) AS coverage_ratio, CASE WHEN len(t) > 0 THEN k::DOUBLE / len(t) < 0.8 ELSE false END AS bad_alignment FROM c""",
    "merge_repeats": f'WITH {_ONCE} SELECT clip_id, seg_idx, target_idx, "start", "end" FROM once',
    "missing_gap_fill": f"""
WITH {_TARGETS}, {_ONCE},
j AS (SELECT tgt.*, o."start" AS st, o."end" AS en FROM tgt LEFT JOIN once o USING (clip_id, seg_idx, target_idx)),
k AS (SELECT *, last_value(en IGNORE NULLS) OVER (PARTITION BY clip_id, seg_idx ORDER BY target_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(st IGNORE NULLS) OVER (PARTITION BY clip_id, seg_idx ORDER BY target_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM j),
m AS (SELECT *, target_idx - row_number() OVER (PARTITION BY clip_id, seg_idx ORDER BY target_idx) AS g FROM k WHERE st IS NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY clip_id, seg_idx, g) AS cnt, row_number() OVER (PARTITION BY clip_id, seg_idx, g ORDER BY target_idx) - 1 AS i FROM m),
o AS (SELECT *, coalesce(b, greatest(0, a - cnt), 0) AS lo FROM n),
q AS (SELECT *, greatest(coalesce(a, lo + cnt) - lo, cnt)::DOUBLE / cnt AS step FROM o)
SELECT clip_id, seg_idx, target_idx, phoneme_id, floor(lo + i * step)::BIGINT AS est_start, greatest(floor(lo + (i + 1) * step)::BIGINT, floor(lo + i * step)::BIGINT + 1) AS est_end FROM q""",
    "sequence_match": f"""
WITH {_TARGETS}, a AS (SELECT clip_id, seg_idx, phoneme_id AS got, (row_number() OVER (PARTITION BY clip_id, seg_idx ORDER BY start_ms, row_id) - 1)::INT AS target_idx, true AS have FROM phoneme_ts WHERE {_V})
SELECT clip_id, seg_idx, min(CASE WHEN a.got IS NOT DISTINCT FROM tgt.phoneme_id THEN 1 ELSE 0 END) AS same FROM tgt FULL JOIN a USING (clip_id, seg_idx, target_idx) GROUP BY clip_id, seg_idx""",
    "confidence_qa": f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY clip_id, seg_idx ORDER BY start_ms, row_id) - 1 AS i, count(*) OVER (PARTITION BY clip_id, seg_idx) AS n
  FROM phoneme_ts WHERE {_V} AND confidence IS NOT NULL AND NOT isnan(confidence)),
q AS (SELECT clip_id, seg_idx, count(*) AS phones, avg((confidence < 0.5)::INT) AS weak, avg(CASE WHEN i >= 10 AND i < 30 THEN confidence END) AS early, avg(CASE WHEN i >= n - 30 AND i < n - 10 THEN confidence END) AS late FROM p GROUP BY ALL)
SELECT clip_id, seg_idx, phones, round(weak, 5) AS weak, round(early, 5) AS early, round(late, 5) AS late, weak > 0.6 OR (early > 0.1 AND late < 0.1) AS bad FROM q WHERE phones > 60""",
    "word_rollup": f"WITH {_LATEST}, {_WORDS} SELECT clip_id, seg_idx, run, word, start_ms, end_ms, round(confidence, 9) AS confidence, phones FROM words",
    "word_rollup_legacy": f"WITH {_LATEST}, {_WORDS} SELECT clip_id, seg_idx, run, word, phones FROM words QUALIFY run < max(run) OVER (PARTITION BY clip_id, seg_idx) OR phones > 1",
    "rollup_hierarchy": f"SELECT clip_id, seg_idx, count(*) AS phones, round(sum(end_ms - start_ms), 6) AS ms, sum(is_estimated::INT)::BIGINT AS estimated, grouping_id(clip_id, seg_idx)::INT AS level FROM phoneme_ts WHERE {_V} GROUP BY ROLLUP (clip_id, seg_idx)",
    "segment_totals": f"SELECT count(*) AS phones, count(DISTINCT clip_id) AS clips, round(avg(confidence), 5) AS confidence, round(max(end_ms) / 1000, 3) AS xmax FROM phoneme_ts WHERE {_V} AND confidence BETWEEN 0 AND 1",
    "clip_regroup": f"WITH {_LATEST} SELECT clip_id, count(*) AS n, string_agg(coalesce(text, ''), ' | ' ORDER BY seg_idx) AS text FROM s GROUP BY clip_id",
    "json_envelope": f"WITH {_LATEST} SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY seg_idx) - 1)::INT AS pos, text FROM s WHERE text IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL",
    "validate_reject": """
SELECT seg_uid, CASE WHEN start_s IS NULL OR end_s IS NULL OR text IS NULL THEN 'missing required keys' ELSE 'no targets' END AS why FROM segments
WHERE start_s IS NULL OR end_s IS NULL OR text IS NULL OR coalesce(len(ph66), 0) < 1""",
    "unpaired_clips": """
SELECT clip_id, CASE WHEN t.clip_id IS NULL THEN 'transcript' ELSE 'clip' END AS missing FROM (SELECT DISTINCT clip_id FROM segments) t FULL JOIN (SELECT DISTINCT clip_id FROM clips) c USING (clip_id) WHERE t.clip_id IS NULL OR c.clip_id IS NULL""",
    "raster_frames": f"WITH {_RASTER} SELECT clip_id, seg_idx, frame, label FROM ras",
    "raster_gap_contract": f"""
WITH {_RASTER},
g AS (SELECT *, lead(frame) OVER (PARTITION BY clip_id, seg_idx ORDER BY frame) AS nx, lead(label) OVER (PARTITION BY clip_id, seg_idx ORDER BY frame) AS rl FROM ras),
h AS (SELECT *, nx - frame - 1 AS n, unnest(range(1, nx - frame)) AS k FROM g WHERE nx > frame + 1),
i AS (SELECT clip_id, seg_idx, frame + k AS frame, CASE WHEN n <= 2 THEN label WHEN n <= 4 THEN (CASE WHEN k <= n // 2 THEN label ELSE rl END) WHEN k <= 2 THEN label WHEN k > n - 2 THEN rl END AS label FROM h)
SELECT clip_id, seg_idx, frame, label FROM ras UNION ALL SELECT * FROM i WHERE label IS NOT NULL""",
    "textgrid_labels": f"""
SELECT row_id, phoneme_label || ' (' || round(confidence::DECIMAL(10, 6), 2)::DECIMAL(10, 2)::VARCHAR || ')' AS text, CASE WHEN confidence > 0.9 THEN 'high' WHEN confidence > 0.6 THEN 'good' WHEN confidence > 0.1 THEN 'weak' ELSE 'poor' END AS band
FROM phoneme_ts WHERE {_V} AND confidence BETWEEN 0 AND 1 AND phoneme_label IS NOT NULL""",
    "tokenise": f"WITH {_TOKENS} SELECT seg_uid, pos, token FROM toks",
    "vocab_stats": """
WITH t AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[.,!?;:]')) AS x FROM documents WHERE text IS NOT NULL),
y AS (SELECT CASE WHEN x IN ('.', ',', '!', '?', ';', ':') THEN '<SIL>' ELSE x END AS token FROM t)
SELECT token, count(*) AS n, token = '<SIL>' AS is_pause FROM y GROUP BY token""",
    "sil_groups": f"""
WITH {_TOKENS}, g AS (SELECT seg_uid, pos, pos - row_number() OVER (PARTITION BY seg_uid ORDER BY pos) AS g FROM toks WHERE token = '<SIL>')
SELECT seg_uid, min(pos) AS start_pos, max(pos) + 1 AS end_pos FROM g GROUP BY seg_uid, g""",
    "word_reindex": f"WITH {_TOKENS} SELECT seg_uid, token, row_number() OVER (PARTITION BY seg_uid ORDER BY pos) - 1 AS word_num FROM toks WHERE token <> '<SIL>'",
    "compound_split": f"""
WITH l AS (SELECT DISTINCT ipa_label FROM phoneme_ts WHERE ipa_label IS NOT NULL AND length(ipa_label) > 1),
c AS (SELECT ipa_label, unnest(range(1, length(ipa_label))) AS cut FROM l),
h AS (SELECT ipa_label, cut, substring(ipa_label, 1, cut) AS "left", substring(ipa_label, cut + 1) AS "right" FROM c),
k AS (SELECT *, "left" IN {_VOWELS} AS lv, "right" IN {_VOWELS} AS rv, "right" IN ('ɹ','ɾ','rʲ','ɚ') AS rr FROM h
  WHERE "left" IN (SELECT phoneme_label FROM alphabet) AND "right" IN (SELECT phoneme_label FROM alphabet)),
s AS (SELECT *, CASE WHEN lv AND rr THEN 10 WHEN lv AND "right" = 'ə' THEN 8 WHEN "left" = 'ə' AND NOT rv THEN 8 WHEN lv AND rv THEN 7 WHEN NOT lv AND rv THEN 6 WHEN lv AND NOT rv THEN 5 ELSE 3 END AS score FROM k)
SELECT ipa_label, "left", "right", score FROM s QUALIFY row_number() OVER (PARTITION BY ipa_label ORDER BY score DESC, cut) = 1""",
}
SQL["ctc_paths"] = f"""
WITH {_FRAMES} SELECT seg, s::INT AS pos, (CASE WHEN s % 4 = 1 THEN tg[s // 4 + 1] ELSE 63 END)::INT AS label, 0::BIGINT AS band FROM targets, (SELECT unnest(range(0, 33)) AS s)"""
SQL["frame_count_rule"] = SQL["frame_count_rule"].replace("7 * (5 * (3 * 4 + 6) + 10) + 15 - 7 * 0 - 0 AS field_", "((((5 - 1) * 3 + 7) - 1) * 5 + 11 - 1) * 7 + 15 AS field")

SQL["annotation_table"] = f"""
SELECT row_id, floor(start_ms / 16)::BIGINT AS frame, phoneme_label AS label, CASE WHEN confidence > 0.9 THEN 'high' WHEN confidence > 0.6 THEN 'good' WHEN confidence > 0.1 THEN 'weak' ELSE 'poor' END AS band
FROM phoneme_ts WHERE {_V} AND confidence BETWEEN 0 AND 1"""
SQL["label_maintenance"] = """
WITH c AS (SELECT phoneme_label AS label, count(*) AS n FROM phoneme_ts WHERE phoneme_label IS NOT NULL GROUP BY 1)
SELECT label, n, label IN (SELECT phoneme_label FROM alphabet) AS known FROM c"""
SQL["label_duplicates"] = "SELECT group_id, count(*) AS n, count(DISTINCT ipa_label) AS spellings FROM alphabet GROUP BY group_id"
SQL["collapse_labels"] = """
WITH l AS (SELECT DISTINCT ipa_label FROM phoneme_ts WHERE ipa_label IS NOT NULL AND ipa_label NOT IN (SELECT phoneme_label FROM alphabet)),
b AS (SELECT ipa_label, regexp_replace(ipa_label, '[:ː]', '', 'g') AS base FROM l)
SELECT ipa_label, CASE WHEN regexp_matches(ipa_label, '[rɹɚ]') THEN 'ɚ' WHEN regexp_matches(ipa_label, '[:ː]') AND base IN (SELECT phoneme_label FROM alphabet) THEN base
  WHEN contains(ipa_label, 'ə') THEN 'ə' WHEN substring(ipa_label, 1, 1) IN (SELECT phoneme_label FROM alphabet) THEN substring(ipa_label, 1, 1) ELSE 'noise' END AS phone FROM b"""


# --- tokenisers by language, phone mapping, documents

_ALL_MARKS = _class(ENDERS + PAUSES)
_PAUSE_OF = f"CASE WHEN length(c) = 1 AND contains('{ENDERS}', c) THEN ['<SIL>', '<SIL>'] WHEN length(c) = 1 AND contains('{PAUSES}', c) THEN ['<SIL>'] ELSE"
_ALPHA_LIST = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[.,!?;:]'), lambda x: CASE WHEN x IN ('.', ',', '!', '?', ';', ':') THEN '<SIL>' ELSE x END)"
_UNSPACED_LIST = f"flatten(list_transform(regexp_extract_all(text, '<SIL>|\\S'), lambda c: {_PAUSE_OF} [c] END))"
_OF_MARKS = f"flatten(list_transform(list_filter(string_split({{}}, ''), lambda c: c <> ''), lambda c: {_PAUSE_OF} []::VARCHAR[] END))"
_CORE = f"regexp_replace(regexp_replace(t, '^{_ALL_MARKS}*', ''), '{_ALL_MARKS}*$', '')"
_PARTS = f"""CASE WHEN t = '<SIL>' THEN ['<SIL>'] WHEN {_CORE} = '' THEN {_OF_MARKS.format("t")}
  ELSE list_concat(list_concat({_OF_MARKS.format(f"regexp_extract(t, '^{_ALL_MARKS}*')")}, [{_CORE}]), {_OF_MARKS.format(f"regexp_extract(t, '{_ALL_MARKS}*$')")}) END"""
_SPACED_LIST = f"flatten(list_transform(regexp_extract_all(replace(text, '<SIL>', ' <SIL> '), '\\S+'), lambda t: {_PARTS}))"


def _tokens_of(lists: str) -> str:
    return f"""
WITH l AS (SELECT seg_uid, {lists} AS x FROM segments WHERE text IS NOT NULL)
SELECT seg_uid, unnest(range(len(x)))::INT AS pos, unnest(x) AS token FROM l"""


SQL["tokenise_unspaced"] = _tokens_of(_UNSPACED_LIST)
SQL["tokenise_spaced"] = _tokens_of(_SPACED_LIST)
SQL["tokenise_by_language"] = _tokens_of(f"CASE seg_uid % 5 WHEN 1 THEN {_SPACED_LIST} WHEN 4 THEN {_SPACED_LIST} WHEN 2 THEN {_UNSPACED_LIST} ELSE {_ALPHA_LIST} END")
_AT_ENDS = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
SQL["ipa_normalise"] = f"SELECT DISTINCT ipa_label, regexp_replace(nfc_normalize(ipa_label), '^{_AT_ENDS}|{_AT_ENDS}$', '', 'g') AS form FROM phoneme_ts WHERE ipa_label IS NOT NULL"
SQL["label_mapping"] = f"""
WITH RECURSIVE k AS (SELECT list(phoneme_label) AS ks FROM alphabet),
d AS (SELECT DISTINCT ipa_label AS l FROM phoneme_ts WHERE ipa_label IS NOT NULL),
cs AS (SELECT * FROM ({SQL["compound_split"]})),
g(l, rest, p) AS (
  SELECT l, l, []::VARCHAR[] FROM d UNION ALL
  SELECT l, substring(rest, greatest(n, 1) + 1), CASE WHEN n > 0 THEN list_append(p, substring(rest, 1, n)) ELSE p END
  FROM (SELECT l, rest, p, coalesce(list_max(list_transform(list_filter(ks, lambda x: starts_with(rest, x)), lambda x: length(x))), 0)::BIGINT AS n FROM g, k WHERE length(rest) > 0)),
r AS (SELECT l, array_to_string(p, ' ') AS p FROM g WHERE length(rest) = 0),
m AS (SELECT ipa_label AS l, min(phoneme_label) AS p FROM alphabet GROUP BY 1)
SELECT d.l AS ipa_label,
  CASE WHEN d.l IN (SELECT phoneme_label FROM alphabet) THEN d.l WHEN m.p IS NOT NULL THEN m.p WHEN cs."left" IS NOT NULL THEN cs."left" || ' ' || cs."right" WHEN r.p <> '' THEN r.p ELSE 'noise' END AS phones,
  CASE WHEN d.l IN (SELECT phoneme_label FROM alphabet) THEN 'direct' WHEN m.p IS NOT NULL THEN 'compound' WHEN cs."left" IS NOT NULL THEN 'split' WHEN r.p <> '' THEN 'greedy' ELSE 'noise' END AS way
FROM d LEFT JOIN m USING (l) LEFT JOIN cs ON cs.ipa_label = d.l LEFT JOIN r USING (l)"""
SQL["phone_expansion"] = """
WITH m AS (SELECT phoneme_label AS l, phoneme_label AS p FROM alphabet UNION SELECT ipa_label, phoneme_label FROM alphabet WHERE ipa_label NOT IN (SELECT phoneme_label FROM alphabet))
SELECT row_id, 0 AS part, m.p AS mapped, ipa_label AS ipa FROM phoneme_ts JOIN m ON ipa_label = m.l WHERE m.p <> 'noise'"""
SQL["mapping_faults"] = """
WITH m AS (SELECT DISTINCT ipa_label AS label, phoneme_label AS phone FROM phoneme_ts WHERE ipa_label IS NOT NULL AND phoneme_label IS NOT NULL)
SELECT label, 'repeated' AS fault FROM m GROUP BY label HAVING count(DISTINCT phone) > 1
UNION SELECT label, 'unknown' FROM m WHERE phone NOT IN (SELECT phoneme_label FROM alphabet)
UNION SELECT a.label, CASE WHEN b.phone = a.label THEN 'cycle' ELSE 'chain' END FROM m a JOIN m b ON a.phone = b.label WHERE a.label <> a.phone AND b.label <> b.phone"""
SQL["segment_documents"] = f"""
WITH {_LATEST}, w AS (SELECT clip_id, seg_idx, ph66, word_num FROM s WHERE ph66 IS NOT NULL),
p AS (SELECT p.*, CASE WHEN target_seq_idx >= 0 THEN w.word_num[target_seq_idx + 1] END AS word FROM phoneme_ts p JOIN w USING (clip_id, seg_idx) WHERE {_V} AND confidence IS NOT NULL AND NOT isnan(confidence) AND phoneme_id IS NOT NULL),
g AS (SELECT clip_id, seg_idx, count(*) AS phones, count(DISTINCT word) AS spans, list(DISTINCT phoneme_id) AS ids, count(*) FILTER (confidence > 0.5) AS c FROM p GROUP BY 1, 2),
j AS (SELECT w.clip_id, w.seg_idx, list_distinct(ph66) AS t, coalesce(ids, []) AS a, coalesce(phones, 0) AS phones, coalesce(spans, 0) AS spans, coalesce(c, 0) AS c FROM w LEFT JOIN g USING (clip_id, seg_idx)),
b AS (SELECT *, len(list_intersect(t, a)) AS n FROM j)
SELECT clip_id, seg_idx, phones::INT AS phones, spans::INT AS spans, len(t)::INT AS target_count, len(a)::INT AS aligned_count, round(CASE WHEN len(t) > 0 THEN n / len(t) ELSE 1 END, 5) AS coverage_ratio,
  (len(t) - n)::INT AS missing, (len(a) - n)::INT AS extra, c::INT AS confident FROM b"""
SQL["large_windows"] = "SELECT vec_id, w::INT AS w, round(embedding[w * 5 + 1]::DOUBLE, 5) AS first, 40 AS n FROM embeddings, (SELECT unnest(range(5)) AS w)"
SQL["alignment_totals"] = f"""
SELECT count(DISTINCT struct_pack(c := clip_id, s := seg_idx)) FILTER (clip_id IS NOT NULL AND seg_idx IS NOT NULL) AS segments, 0::BIGINT AS failed, count(*) AS phonemes,
  sum(is_estimated::INT)::BIGINT AS estimated, round(avg(confidence), 5) AS confidence, round(avg(end_ms - start_ms), 4) AS ms FROM phoneme_ts WHERE {_V} AND confidence BETWEEN 0 AND 1"""

_PHONE_OF = "MAP {" + ", ".join(f"'{g}': '{p}'" for g, p in GRAPHEMES.items()) + "}"
_PAIRS = "|".join(g for g in GRAPHEMES if len(g) == 2)
SQL["pronounce"] = f"""
WITH {_TOKENS}, w AS (SELECT seg_uid, pos AS word_idx, token AS word, CASE WHEN token = '<SIL>' THEN ['SIL']
  ELSE list_transform(regexp_extract_all(lower(token), '{_PAIRS}|.'), lambda g: coalesce({_PHONE_OF}[g], 'noise')) END AS p FROM toks)
SELECT seg_uid, word_idx, word, unnest(range(len(p)))::INT AS phone_idx, unnest(p) AS phone FROM w"""
SQL["textgrid_text"] = f"""
WITH r AS (
  SELECT clip_id, seg_idx, 1 AS tier_no, 'phonemes' AS tier, row_id AS k, start_ms / 1000 AS xmin, end_ms / 1000 AS xmax, phoneme_label AS text FROM phoneme_ts WHERE {_V} AND phoneme_label IS NOT NULL
  UNION ALL SELECT clip_id, seg_idx, 2, 'words', run, start_ms / 1000, end_ms / 1000, word::VARCHAR FROM ({SQL["word_rollup"]})),
t AS (SELECT clip_id, seg_idx, tier_no, tier, max(xmax) AS top, list(struct_pack(a := xmin, b := xmax, t := text) ORDER BY xmin, k, xmax, text) AS x FROM r GROUP BY 1, 2, 3, 4),
m AS (SELECT *, max(top) OVER (PARTITION BY clip_id, seg_idx) AS whole FROM t),
b AS (SELECT clip_id, seg_idx, tier_no, whole,
  '        class = "IntervalTier"' || chr(10) || '        name = "' || tier || '"' || chr(10) || '        xmin = 0' || chr(10) || printf('        xmax = %.6f', whole) || chr(10) || '        intervals: size = ' || len(x) || chr(10)
  || array_to_string(list_transform(x, lambda v, i: '        intervals [' || i || ']:' || chr(10) || printf('            xmin = %.6f', v.a) || chr(10) || printf('            xmax = %.6f', v.b) || chr(10) || '            text = "' || replace(v.t, '"', '""') || '"' || chr(10)), '') AS body FROM m),
g AS (SELECT clip_id, seg_idx, max(whole) AS whole, list(body ORDER BY tier_no) AS y FROM b GROUP BY 1, 2)
SELECT clip_id, seg_idx, 'File type = "ooTextFile"' || chr(10) || 'Object class = "TextGrid"' || chr(10) || chr(10) || 'xmin = 0' || chr(10) || printf('xmax = %.6f', whole) || chr(10) || 'tiers? <exists>' || chr(10) || 'size = ' || len(y) || chr(10) || 'item []:' || chr(10)
  || array_to_string(list_transform(y, lambda v, i: '    item [' || i || ']:' || chr(10) || v), '') AS grid FROM g"""
