"""Splitting items over a length or duration limit at natural boundaries.

Every position of a text has a strength as a place to end a piece: sentence end 3, clause end 2, word
end 1, inside a word 0.  A sparse table answers "strongest position in a window, rightmost on ties"
in constant time.  A piece starting at ``a`` ends at the strongest position whose distance from ``a``
is permissible (half the limit up to the limit); if nothing but word insides are there, the shorter
distances are asked too; if those have none either, the piece is cut at the limit.  The next piece
starts ``overlap`` characters before that end, moved right to the next word start; in scripts without
spaces every character is one.  If the last word is longer than the overlap, the overlap is the end of
that word.

Times run evenly over the characters of an item.  A text that is short for its duration is cut so
that each piece keeps to the time limit; where that leaves less than one character for a piece, time
is divided evenly and the characters shared out, and such pieces don't overlap.

Defined results: an item within both limits is one piece, whatever its text.  Null and empty texts
are pieces without text, divided only by time.  A start or end that is null, NaN or infinite, or an
end not after the start, means no times: the pieces' times are null and only the length limit
holds.  Repeated rows are split each on its own; an empty table gives no rows.  Very long texts are
worked on as a whole: the table's height is the logarithm of the limit, not of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, map_arrow, parts

#: Ends of sentences and clauses, and what may stand between them and the space.
SENTENCE_END = ".!?…。！？؟।"
CLAUSE_END = ",;:–—、，；：؛،"
CLOSING = "\"'”’»)]}"


@lru_cache(1)
def _strength_table() -> np.ndarray:
    """Class of the characters of the basic plane: 0 letter, 1 space, 2 clause end, 3 sentence end, 4 closing mark."""
    kinds = np.zeros(0x110000, np.int8)
    for c in range(0x3100):
        if chr(c).isspace():
            kinds[c] = 1
    for marks, kind in ((CLAUSE_END, 2), (SENTENCE_END, 3), (CLOSING, 4)):
        for c in marks:
            kinds[ord(c)] = kind
    return kinds


def strengths(text: str) -> np.ndarray:
    """Strength of an end before each position 0..len(text)."""
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _strength_table()[points]
    # The kind of the last character that is no closing mark, for "word.)" and the like.
    at = np.where(kind == 4, 0, np.arange(n))
    behind = kind[np.maximum.accumulate(at)] if n else kind
    out = np.zeros(n + 1, np.int8)
    if n:
        space_next = np.append(kind[1:] == 1, True)
        word_end = (kind != 1) & space_next
        wide = points > 0x2E7F  # marks of scripts without spaces end a sentence by themselves
        ends = np.where(word_end, np.where(behind == 3, 3, np.where(behind == 2, 2, 1)), 0)
        ends = np.where(wide & ((kind == 3) | (kind == 2)), kind, ends)
        out[1:] = ends
        out[n] = 3
    return out


class StrongestCut:
    """Range maximum over strengths, rightmost on ties, by a sparse table of the windows of up to ``widest`` positions."""

    def __init__(self, strength: np.ndarray, widest: int):
        n = len(strength)
        self.n = n
        # strength and position in one integer: the larger is the stronger, then the one further right
        level = strength.astype(np.int64) * n + np.arange(n)
        self.levels = [level]
        for k in range(1, max(1, min(widest, n)).bit_length()):
            half = 1 << (k - 1)
            level = np.maximum(level[:-half], level[half:]) if len(level) > half else level
            self.levels.append(level)

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """Position and strength of the strongest cut in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        v = int(max(level[lo], level[hi - (1 << k) + 1]))
        return v % self.n, v // self.n


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a text."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    strength = strengths(text)
    table = StrongestCut(strength, limit)
    overlap = min(overlap, limit * 2 // 5)
    pieces, a, end = [], 0, 0
    while n - a > limit:
        hi = a + limit
        low = max(end + 1, a + 1)
        lo = min(hi, max(low, a + (limit + 1) // 2))
        b, strong = table.best(lo, hi)
        if not strong and low < lo:
            shorter, strong = table.best(low, lo - 1)
            b = shorter if strong else b
        pieces.append((a, b))
        end = b
        a = _word_start(text, max(b - overlap, a + 1), b) if overlap else b
    pieces.append((a, n))
    return pieces


def _word_start(text: str, at: int, end: int) -> int:
    """The first start of a word in at..end; at itself if a word without an end goes through all of it."""
    for i in range(at, end):
        if not text[i].isspace() and (text[i - 1].isspace() or _unspaced(text[i])):
            return i
    return at if not text[at].isspace() else end


def _unspaced(c: str) -> bool:
    """Whether a character is of a script that is written without spaces: Thai, Lao, Burmese, Khmer, Kana, Han."""
    return c > "\u0e00" and (c < "\u0f00" or "\u1000" <= c < "\u10a0" or "\u1780" <= c < "\u1800" or "\u3040" <= c < "\ua000" or "\U00020000" <= c)


def pieces_of(text: str | None, start: float | None, end: float | None, max_chars: int, max_seconds: float, overlap: int) -> list[tuple[int, int, float | None, float | None]]:
    """(first character, end character, start, end) of each piece of one item."""
    n = len(text or "")
    timed = start is not None and end is not None and math.isfinite(start) and math.isfinite(end) and end > start
    seconds = end - start if timed else 0.0
    if n <= max_chars and seconds <= max_seconds:
        return [(0, n, start if timed else None, end if timed else None)]
    limit = max_chars
    if seconds > max_seconds:
        limit = min(limit, int(max_seconds * n / seconds))
        if limit < 1 or n == 0:
            m = math.ceil(seconds / max_seconds)
            return [(i * n // m, (i + 1) * n // m, start + seconds * i / m, start + seconds * (i + 1) / m) for i in range(m)]
    at = (lambda i: start + seconds * (i / n)) if timed else lambda i: None
    return [(a, b, at(a), at(b)) for a, b in cut_points(text, limit, overlap)]


def split_oversized(df: DataFrame, item_id: str, text: str, start: Column, end: Column, max_chars: int = 300, max_seconds: float = 30.0, overlap: int = 40) -> DataFrame:
    """item_id, piece, n_pieces, char_start, char_end, piece_text, piece_start_s, piece_end_s, oversized; one row per piece.

    oversized: the item's text has more than max_chars code points, or its start and end are present,
    not NaN, and further apart than max_seconds.  Items within the limits never leave the JVM.
    """
    s, e = start.cast("double"), end.cast("double")
    present = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e)
    over = F.coalesce(F.char_length(text) > max_chars, F.lit(False)) | (present & F.coalesce(e - s > max_seconds, F.lit(False)))
    rows = df.select(F.col(item_id), F.col(text).alias("_text"), s.alias("_s"), e.alias("_e"), over.alias("_over"))
    id_type = df.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 256):
            out: list[list] = [[] for _ in range(9)]
            for rid, t, a, z in zip(*(b.column(i).to_pylist() for i in range(4))):
                cut = pieces_of(t, a, z, max_chars, max_seconds, overlap)
                for k, (i, j, at, to) in enumerate(cut):
                    for column, v in zip(out, (rid, k, len(cut), i, j, t[i:j] if t is not None else None, at, to, True)):
                        column.append(v)
            yield batch(out, schema)

    ddl = f"`{item_id}` {id_type}, piece INT, n_pieces INT, char_start INT, char_end INT, piece_text STRING, piece_start_s DOUBLE, piece_end_s DOUBLE, oversized BOOLEAN"
    cut = map_arrow(rows.where("_over").drop("_over"), run, ddl)
    times = present & (e > s) & (F.abs(s) < float("inf")) & (F.abs(e) < float("inf"))
    whole = df.where(~over).select(
        F.col(item_id), F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.coalesce(F.char_length(text), F.lit(0)).alias("char_end"),
        F.col(text).alias("piece_text"), F.when(times, s).alias("piece_start_s"), F.when(times, e).alias("piece_end_s"), F.lit(False).alias("oversized"),
    )
    return cut.unionByName(whole)
