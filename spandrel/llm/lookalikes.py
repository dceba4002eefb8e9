"""Labels that look like an agreed label but are made of other characters.

A label is first freed of what shows nothing (format characters, blank space at its ends) and of
width and font variants, and its combining marks are put in canonical order.  If that isn't in the
vocabulary, script-aware repair follows: the dominant script of the label is found, and if its
letters are of mixed scripts, those of the other scripts are replaced by their look-alikes; the
result is taken when it is in the vocabulary.

A label of one letter, or wholly of another script, has no mixed scripts, but looks the same as a
vocabulary entry just as well.  So, beyond the named method, a label that this doesn't repair has all
its look-alikes replaced, again only when the result is in the vocabulary.  The table of look-alikes is
a parameter; the default is made for phonetic labels in Latin letters.

Defined results: null labels, labels of the vocabulary itself and labels with visible additions
(stress, tone, aspiration) are no cases; repeated rows are cases each; an empty vocabulary or table
gives no rows.  Labels of any length are looked at whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, combined, map_arrow

#: Characters and the vocabulary characters they look like, by the latter.
LOOK_ALIKES = {
    "a": "аａ", "æ": "ӕ", "ɑ": "α⍺ⲁ", "b": "ЬƄ", "β": "ꞵßϐⲃ", "ç": "ҫ", "d": "ԁ", "e": "е℮", "ə": "әǝ", "ɛ": "εԑⲉ",
    "ɡ": "gց", "ɣ": "γ", "h": "һհ", "i": "іıιꭵ", "j": "јϳ", "l": "ӏǀᛁ", "n": "ո", "o": "оοօᴏⲟ", "ɔ": "ↄᴐͻ", "p": "рρϱⲣ",
    "r": "гꮁ", "s": "ѕꜱꮪ", "ʃ": "∫ꭍ", "θ": "ѳϑⲑ", "u": "սυᴜ", "v": "ѵνᴠꮩ", "ʌ": "ᴧ", "w": "ԝѡᴡաꮃ", "x": "х×ⲭ", "y": "уүⲩ",
    "z": "ᴢꮓ", "ʒ": "ӡȝꝫⳍჳ", "ː": ":꞉：∶˸׃։܃܄᛬⁚ꓽ", "̃": "͂", "̧": "̡",
    "S": "ЅՏ", "I": "ІΙӀ", "L": "Ꮮ", "ts": "ʦ", "tʃ": "ʧ", "dʒ": "ʤ",
}
#: What shows nothing besides the format characters (category Cf).
SHOWS_NOTHING = "͏ᅟᅠ឴឵ㅤﾠ⠀" + "".join(map(chr, range(0xFE00, 0xFE10))) + "\x00"
#: Width, font and number-form variants: the ranges whose compatibility forms look the same.
VARIANTS = ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2160, 0x217F), (0x2100, 0x213A))
#: A vocabulary is broadcast; a larger one is refused.
MOST_TERMS = 1_000_000

_ONE = {ord(c): to for to, chars in LOOK_ALIKES.items() for c in chars}


def plain(label: str) -> str:
    """The label without what shows nothing and without width and font variants, canonically composed."""
    shown = "".join(c for c in label if unicodedata.category(c) != "Cf" and c not in SHOWS_NOTHING).strip()
    same = "".join(unicodedata.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in VARIANTS) else c for c in shown)
    return unicodedata.normalize("NFC", same)


@lru_cache(4096)
def script(c: str) -> str:
    """Script of a letter by its name ('LATIN', 'GREEK', ...); '' for marks and symbols."""
    return unicodedata.name(c, "").split(" ", 1)[0] if unicodedata.category(c)[0] == "L" and unicodedata.category(c) != "Lm" else ""


def dominant_script(label: str) -> tuple[str, bool]:
    """The script of most letters (Latin on ties, then the first), and whether there are others."""
    counts = Counter(s for s in map(script, label) if s)
    if not counts:
        return "", False
    best = max(counts, key=lambda s: (counts[s], s == "LATIN"))
    return best, len(counts) > 1


def replaced(label: str, keep: str | None = None, one: dict[int, str] = _ONE) -> str:
    """The label with look-alikes in place of all characters, or of those not in the script to keep."""
    parts = unicodedata.normalize("NFD", label)
    return unicodedata.normalize("NFC", "".join(c if keep and script(c) == keep else one.get(ord(c), c) for c in parts))


def repaired(label: str, vocabulary: dict[str, str], one: dict[int, str] = _ONE) -> str | None:
    """The vocabulary entry that a label looks the same as; vocabulary: composed form -> entry."""
    p = plain(label)
    if p in vocabulary:
        return vocabulary[p]
    dominant, mixed = dominant_script(p)
    if mixed and (form := vocabulary.get(replaced(p, dominant, one))) is not None:
        return form
    return vocabulary.get(replaced(p, None, one))


def repair(df: DataFrame, keys: list[str], label: str, vocabulary: DataFrame, look_alikes: dict[str, str] = LOOK_ALIKES) -> DataFrame:
    """keys, label, form: rows whose label isn't a value of the one-column vocabulary but looks the same as one.

    Labels that are in the vocabulary, nearly all, are left out by a filter inside the JVM.
    """
    values = [r[0] for r in vocabulary.where(F.col(vocabulary.columns[0]).isNotNull()).distinct().limit(MOST_TERMS + 1).collect()]
    if len(values) > MOST_TERMS:
        raise ValueError("the vocabulary is too large to broadcast")
    known = {unicodedata.normalize("NFC", v): v for v in sorted(values)}
    one = {ord(c): to for to, chars in look_alikes.items() for c in chars}
    shared = df.sparkSession.sparkContext.broadcast((known, one))

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        (terms, one), seen = shared.value, {}
        for b in batches:
            coded = combined(b.column(len(keys))).dictionary_encode()
            forms = []
            for v in coded.dictionary.to_pylist():
                if v not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[v] = repaired(v, terms, one)
                forms.append(seen[v])
            t = pa.Table.from_arrays([*b.columns, pa.array(forms, pa.string()).take(coded.indices)], schema=schema)
            yield from t.filter(t.column(len(keys) + 1).is_valid()).combine_chunks().to_batches()

    rows = df.where(F.col(label).isNotNull())
    if len(values) <= 10_000:
        rows = rows.where(~F.col(label).isin(values)) if values else rows.where(F.lit(False))
    else:
        rows = rows.join(F.broadcast(vocabulary.select(F.col(vocabulary.columns[0]).alias(label)).distinct()), label, "left_anti")
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", `{label}` STRING, form STRING"
    return map_arrow(rows.select(*keys, label), run, ddl)
