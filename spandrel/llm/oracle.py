"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

import unicodedata

from spandrel.llm import lookalikes
from spandrel.llm.queries import AT

_TERMS = """
WITH tokens AS (
  SELECT 'ipa_label' AS field, ipa_label AS term, clip_id, seg_idx FROM phoneme_ts
  UNION ALL SELECT 'phoneme_label', phoneme_label, clip_id, seg_idx FROM phoneme_ts),
counts AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT struct_pack(c := clip_id, s := seg_idx)) AS records
  FROM tokens WHERE term IS NOT NULL GROUP BY field, term),
total AS (SELECT count(DISTINCT struct_pack(c := clip_id, s := seg_idx)) AS n FROM phoneme_ts),
marked AS (
  SELECT field, term, occurrences, records,
    CASE WHEN records <= 3 THEN 'rare' WHEN records > 0.5 * n THEN 'common' END AS mark
  FROM counts, total)
"""


_OVERSIZED = "length(text) > 300 OR (NOT isnan(start_s) AND NOT isnan(end_s) AND end_s - start_s > 30)"
#: Percentiles of up to a buffer's values are exact; at the scale that is compared no label has more on a day.
_PERCENTILES = ", ".join(f"list_extract(v, greatest(1, ceil({q} * n - 1e-9))::BIGINT) AS {name}" for name, q in AT.items())


def _look_alikes() -> str:
    """Labels of both fields and what each looks the same as, from the operator's own fixed tables."""
    plain = {c: unicodedata.normalize("NFKC", c) for a, b in lookalikes.VARIANTS for c in map(chr, range(a, b + 1))}
    one = {c: x for c, x in plain.items() if len(x) == 1 and c != x}
    many = {c: x for c, x in plain.items() if len(x) > 1}
    for to, chars in lookalikes.LOOK_ALIKES.items():
        for c in chars:
            (one if len(to) == 1 else many)[c] = to
    one = {c: one.get(x, x) for c, x in one.items()}  # a variant of a look-alike
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    nothing = "[\\p{Cf}" + "".join(f"\\x{{{ord(c):X}}}" for c in lookalikes.SHOWS_NOTHING) + "]"
    ends = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
    shown = f"nfc_normalize(regexp_replace(regexp_replace(x, '{nothing}', '', 'g'), '^{ends}|{ends}$', '', 'g'))"
    looks = "shown"
    for c, x in many.items():
        if c in "ʦʧʤ":
            looks = f"replace({looks}, {quote(c)}, {quote(x)})"
    looks = f"nfc_normalize(translate({looks}, {quote(''.join(one))}, {quote(''.join(one.values()))}))"
    return f"""
WITH a AS (SELECT DISTINCT ipa_label AS form, nfc_normalize(ipa_label) AS k FROM alphabet WHERE ipa_label IS NOT NULL),
r AS (SELECT 'ipa_label' AS field, row_id AS row_key, -1 AS pos, ipa_label AS x FROM phoneme_ts
  UNION ALL SELECT 'ipa', seg_uid, unnest(range(len(ipa)))::INT, unnest(ipa) FROM segments),
d AS (SELECT DISTINCT x FROM r WHERE x IS NOT NULL AND x NOT IN (SELECT form FROM a)),
s AS (SELECT x, {shown} AS shown FROM d),
l AS (SELECT x, shown, {looks} AS looks FROM s),
f AS (SELECT x, coalesce(p.form, q.form) AS form FROM l LEFT JOIN a p ON p.k = shown LEFT JOIN a q ON q.k = looks)
SELECT field, row_key, pos, form FROM r JOIN f USING (x) WHERE form IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_faults": f"SELECT seg_uid, false AS faulty FROM segments WHERE {_OVERSIZED}",
        "p3_within_error": "SELECT phoneme_label, count(*) AS n, true AS within FROM phoneme_ts WHERE confidence BETWEEN 0 AND 1 GROUP BY phoneme_label",
        "p3_daily_percentiles": f"""
WITH g AS (SELECT phoneme_label, loaded_at::DATE AS loaded_on, count(*) AS n, list(confidence ORDER BY confidence) AS v FROM phoneme_ts WHERE confidence BETWEEN 0 AND 1 GROUP BY ALL)
SELECT phoneme_label, loaded_on, n, 0::BIGINT AS rank_error, {_PERCENTILES} FROM g""",
        "p6_found": _look_alikes(),
        "p7_faults": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split, 0::BIGINT AS torn, 0::BIGINT AS over_full, 0::BIGINT AS overlapping FROM documents WHERE length(text) > 0",
        "p2_found": """
SELECT seg_uid FROM segments
WHERE length(text) > 300 OR (NOT isnan(start_s) AND NOT isnan(end_s) AND end_s - start_s > 30)
""",
        "p4_found": _TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
        "p4_terms": _TERMS + "SELECT field, term, occurrences::BIGINT AS occurrences, records::BIGINT AS records, mark FROM marked",
    }
