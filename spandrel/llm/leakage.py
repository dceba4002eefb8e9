"""Evaluation passages that appear, whole or in part and damaged, in a corpus.

Texts are folded: letters lose case, accents and what character recognition confuses; all but letters
and digits goes, and with it the breaks of words, lines and cues.  One Aho-Corasick automaton holds
the anchors of all items, ANCHOR folded characters from every place on; a document's dialogue is
scanned once, and every folded character has its offset in the original text.

From a hit, the item's words are sought one after the other at their places in the document, to both
sides, and where enough of ``least`` consecutive words stands there (STANDING of their characters) what
is missing between them is aligned with what is there, character by character.
A word of the item is shown if at least SHOWN of it is aligned; lost if nothing stands in its place;
else something else stands there and the run of shown words ends.  A run also ends where dialogue of
another cue or more than MOST_ADDED characters come between.  A document shows an item if a run has
at least ``least`` words.  So texts of the same build with other names or numbers, and the item's
words in another order, aren't found, and damaged, joined, split, lost or added words don't matter.

The anchors that are scanned for are an item's own: owned by at most SHARED items, as what more items
own is their sentence's mould.  Stretches of ``least`` words in which own anchors cover less than OWN
characters have nothing of their own that damage would leave, so there every anchor counts as own;
words that stand in any number of items are found for each of these.

Items come in blocks of about BLOCK_CHARS characters, one automaton each, so that what is broadcast
stays bounded whatever the number of items.  Owners are counted over all blocks, so that blocks don't
change results.

Defined results: null and empty documents and items show nothing; repeated documents are found each;
ties don't occur, as each pair counts once.  Whole texts are scanned, of any length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, map_arrow, parts
from spandrel.llm import subtitles
from spandrel.session import settled

#: Folded characters of an anchor; one starts at every character of an item.
ANCHOR = 10
#: Owners up to which an anchor is an item's own, and characters of a stretch of words that own ones must cover or all anchors of it count as own.
SHARED, OWN = 2, 9
#: Part of the characters of a stretch of words that must stand at their places for it to be aligned.
STANDING = 0.5
#: How far beyond its place a word is sought, and words in a row that may not be found.
BEHIND, MISSED = 48, 6
#: Folded characters around its place in which a damaged word is looked for.
AROUND = 12
#: Folded characters of words found one behind the other from which on these hold, and characters beyond the words that are aligned with what is missing at the ends.
SOLID, MARGIN = 8, 60
#: Part of a word's folded characters that must be aligned for it to be shown; of a number, all.
SHOWN = 0.7
#: Folded characters that may be added between two words of a run, and words that may be lost in a row.
MOST_ADDED, MOST_LOST = 40, 2
#: Folded characters added beside or inside a damaged word from which on it is another word.
OTHER = 4
#: Characters of a block of items.
BLOCK_CHARS = 2_000_000

#: What character recognition confuses, folded to one spelling.
CONFUSED = {
    "l": "i", "1": "i", "|": "i", "j": "i", "0": "o", "5": "s", "c": "e", "f": "t", "8": "b",
    "m": "rn", "w": "vv", "d": "ei", "h": "ii", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "i", "đ": "ei", "ı": "i",
}
#: Those of one ASCII letter that become two.
_TWO = [(c, to) for c, to in CONFUSED.items() if c.isascii() and len(to) == 2]
#: Kept by folding besides letters and digits, as lines and cues are told apart after it.
_KEPT = ("\n", subtitles.CUE)
_ASCII = {k: c if c in _KEPT else None for k in range(128) if not (c := chr(k)).isalnum()} | {ord("|"): "i"}
_ASCII |= {k: c if len(to := CONFUSED.get(c, c)) == 2 else to for k in range(128) if (c := chr(k).lower()).isalnum()}


class _Fold(dict):
    """A character outside ASCII to its folded form, '' for what folding drops."""

    def __missing__(self, char: str) -> str:
        self[char] = out = "".join(CONFUSED.get(c, c) for c in unicodedata.normalize("NFKD", char.lower()) if c.isalnum())
        return out


_FOLD = _Fold()
_OUTSIDE = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def folded(text: str) -> str:
    """The text's letters and digits in their folded form, line feeds and marks of cues."""
    if not text.isascii():
        text = _OUTSIDE.sub(lambda m: _FOLD[m[0]], text)
    text = text.translate(_ASCII)
    for c, to in _TWO:
        text = text.replace(c, to)
    return text


class Item:
    """An item's folded text and where its words are in it."""

    __slots__ = ("item_id", "text", "starts", "ends", "number", "_shortest")

    def __init__(self, item_id, text: str):
        self.item_id = item_id
        words = [(w, f) for w in _WORD.findall(text) if (f := folded(w))]
        self.text = "".join(f for _, f in words)
        ends = np.cumsum([len(f) for _, f in words]).tolist() if words else []
        self.ends, self.starts = ends, [0, *ends[:-1]] if ends else []
        self.number = [w.isdigit() for w, _ in words]
        self._shortest: dict[int, int] = {}

    def shortest(self, least: int) -> int:
        """Characters of its shortest stretch of so many words."""
        if least not in self._shortest:
            self._shortest[least] = min((e - s for s, e in zip(self.starts, self.ends[least - 1 :])), default=0)
        return self._shortest[least]


def anchors(item: Item) -> list[str]:
    """The anchor at each place of an item; an item shorter than one has none."""
    return [item.text[at : at + ANCHOR] for at in range(len(item.text) - ANCHOR + 1)]


def covered(places: set[int]) -> int:
    """Characters of an item that anchors at these places cover."""
    total, until = 0, 0
    for at in sorted(places):
        total += at + ANCHOR - max(at, until)
        until = at + ANCHOR
    return total


class Automaton:
    """Own anchors of items: folded text -> the (item, place) pairs of its owners.

    shared: the anchors that more than SHARED items own, where these aren't all the items; else they are counted.
    """

    def __init__(self, items: list[tuple[object, str]], least: int = 12, shared: set[str] | None = None):
        self.items, self.least = [Item(i, t) for i, t in items], least
        own: dict[str, list[tuple[int, int]]] = defaultdict(list)
        all_of = [anchors(item) for item in self.items]
        if shared is None:
            owners: dict[str, int] = defaultdict(int)
            for of in all_of:
                for anchor in set(of):
                    owners[anchor] += 1
            shared = {x for x, n in owners.items() if n > SHARED}
        for k, (item, of) in enumerate(zip(self.items, all_of)):
            bare = self.bare(item, of, least, shared)
            for at, anchor in enumerate(of):
                if anchor not in shared or anchor in bare:
                    own[anchor].append((k, at))
        self.owned = list(own.values())
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for v, anchor in enumerate(own):
            self.found.add_word(anchor, v)
        if own:
            self.found.make_automaton()
        self.any = bool(own)

    @staticmethod
    def bare(item: Item, all_of: list[str], least: int, shared: set[str]) -> set[str]:
        """Shared anchors in stretches of so many words that have too little of their own."""
        out: set[str] = set()
        for s, e in zip(item.starts, item.ends[least - 1 :]):
            inside = range(s, e - ANCHOR + 1)
            if covered({at for at in inside if all_of[at] not in shared}) < OWN:
                out.update(all_of[at] for at in inside if all_of[at] in shared)
        return out

    def hits(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """(place in the folded text, place in the item) of the own anchors of each item, in order."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, v in self.found.iter(text):
            for k, at in self.owned[v]:
                hits.setdefault(k, []).append((end - ANCHOR + 1, at))
        return hits

    def standing(self, text: str, k: int, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Stretches of an item that may stand in the text, from its hits: first and last word sought, (word, place in the text) of each found."""
        item, walked = self.items[k], []
        for place, at in hits:
            w = bisect.bisect_right(item.starts, at) - 1
            if any(abs(off - place + at) <= 2 for offs in walked for x in range(w, w + 3) if (off := offs.get(x)) is not None):
                continue  # in a stretch that was walked before
            first, last, pairs = walk(item, text, place, at)
            if pairs:
                walked.append({x: p - item.starts[x] for x, p in pairs})
                if stands(item, self.least, pairs) and possible(item, text, first, last, pairs) >= self.least:
                    yield first, last, pairs


def walk(item: Item, text: str, place: int, at: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Seeks an item's words to both sides of an anchor: first and last word sought, (word, place in the text) of each found.

    A word is sought near the place that the words before it make likely; the walk ends where MISSED
    words in a row aren't there.
    """
    starts, ends, whole = item.starts, item.ends, item.text
    begin = bisect.bisect_right(starts, at) - 1
    right: list[tuple[int, int]] = []
    off, missed, last, edge = place - at, 0, begin, max(0, place - at + starts[begin] - 2)
    for w in range(begin, len(starts)):
        s, e = starts[w], ends[w]
        last = w
        p = text.find(whole[s:e], edge, e + off + BEHIND)
        if p < 0:
            missed += 1
            if missed >= MISSED:
                break
        else:
            right.append((w, p))
            off, missed, edge = p - s, 0, p + e - s
    left: list[tuple[int, int]] = []
    off, missed, first, edge = place - at, 0, begin, right[0][1] if right else place + 2
    for w in range(begin - 1, -1, -1):
        s, e = starts[w], ends[w]
        first = w
        p = text.rfind(whole[s:e], max(0, s + off - BEHIND), edge)
        if p < 0:
            missed += 1
            if missed >= MISSED:
                break
        else:
            left.append((w, p))
            off, missed, edge = p - s, 0, p
    return first, last, left[::-1] + right


def stands(item: Item, least: int, pairs: list[tuple[int, int]]) -> bool:
    """Whether the words found are STANDING of the characters of some ``least`` consecutive words."""
    starts, ends, n = item.starts, item.ends, len(item.starts)
    if n < least or STANDING * item.shortest(least) > sum(ends[w] - starts[w] for w, _ in pairs):
        return False
    there, total, i, j = [ends[w] - starts[w] for w, _ in pairs], 0, 0, 0
    for w in range(max(0, pairs[0][0] - least + 1), min(n - least, pairs[-1][0]) + 1):
        while j < len(pairs) and pairs[j][0] < w + least:
            total += there[j]
            j += 1
        while i < j and pairs[i][0] < w:
            total -= there[i]
            i += 1
        if total >= STANDING * (ends[w + least - 1] - starts[w]):
            return True
    return False


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def possible(item: Item, text: str, first: int, last: int, pairs: list[tuple[int, int]]) -> int:
    """Words that a run can have at most.

    It can't go on where not all the words missing between two found can be shown and something else is there.
    """
    starts, ends = item.starts, item.ends

    def may_be(k: int, there: str) -> bool:
        word = item.text[starts[k] : ends[k]]
        return common(word, there) >= (len(word) if item.number[k] else SHOWN * len(word))

    def beyond(words: range, at: int, way: int) -> int:
        """How many of the words at an end that weren't found may still be shown or lost."""
        n = lost = 0
        for i, k in enumerate(words, 1):
            size = ends[k] - starts[k]
            reach = size + AROUND
            if may_be(k, text[at : at + reach] if way > 0 else text[max(0, at - reach) : at]):
                n, lost, at = i, 0, max(0, at + way * size)
            elif (lost := lost + 1) > MOST_LOST:
                break
        return n

    (w, p), best = pairs[0], 0
    run = 1 + beyond(range(w - 1, first - 1, -1), p, -1)
    for (w, p), (v, q) in zip(pairs, pairs[1:]):
        gap = text[p + ends[w] - starts[w] : q]
        there = [ends[k] - starts[k] for k in range(w + 1, v) if may_be(k, gap)]
        lost = v - w - 1 - len(there)
        if len(gap) - sum(there) > (2 + OTHER * len(there) if lost else MOST_ADDED) or lost > MOST_LOST * (len(there) + 1):
            best, run = max(best, run + MOST_LOST), 0
        run += v - w if run else 1 + MOST_LOST
    w, p = pairs[-1]
    return max(best, run + beyond(range(w + 1, last + 1), p + ends[w] - starts[w], 1))


class Folded:
    """A document's folded dialogue; offsets and cues of its characters are made where they are asked for."""

    def __init__(self, source: str):
        self.source = source
        self.spoken = subtitles.spoken(source)
        keys = folded("\n".join(self.spoken)).split("\n")
        kept, lines, cues, recent = [], [], [], []
        cue, fresh = -1, True
        for i, key in enumerate(keys):
            if not key:
                continue
            if key[0] == subtitles.CUE:
                fresh = True
            elif key not in recent:  # else a repeated line
                recent = [*recent[-3:], key]
                cue += fresh
                fresh = False
                kept.append(key)
                lines.append(i)
                cues.append(cue)
        self.text, self.lines, self._cues, self._kept = "".join(kept), lines, cues, kept
        self._starts: list[int] | None = None

    def starts(self) -> list[int]:
        if self._starts is None:
            self._starts = [0, *np.cumsum([len(k) for k in self._kept]).tolist()]
        return self._starts

    def cues(self, lo: int, hi: int) -> list[int]:
        """The cue of each folded character from lo to hi."""
        starts = self.starts()
        i = bisect.bisect_right(starts, lo) - 1
        out: list[int] = []
        while len(out) < hi - lo:
            out += [self._cues[i]] * (min(hi, starts[i + 1]) - max(lo, starts[i]))
            i += 1
        return out

    def offset(self, at: int) -> int:
        """The offset in the original text of a folded character."""
        starts = self.starts()
        i = bisect.bisect_right(starts, at) - 1
        k, left = self.lines[i], at - starts[i]
        lines = subtitles.file_lines(self.source)
        begin = sum(map(len, lines[:k])) + k
        places = subtitles.ungarbled_places(lines[k])
        for j, c in enumerate(self.spoken[k]):
            left -= len(folded(c)) if c not in _KEPT else 0
            if left < 0:
                return begin + places[j]
        return begin


def aligned(item: str, region: str, whole: bool = True) -> list[int]:
    """For each character of the item, the place in the region it is aligned with, or -1.

    Both begin together; they end together too, or, if not ``whole``, where the alignment is best.

    Rows are kept with the cost of a gap along the row added to them, so that such gaps are a running
    maximum; row i and place j stand for i characters of the item and j of the region.
    """
    n, m = len(item), len(region)
    out = [-1] * n
    if not n or not m:
        return out
    gap, same, other = 2, 3, -3
    b = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = {c: np.where(b == ord(c), same + gap, other + gap).astype(np.int32) for c in set(item)}
    rows = np.empty((n + 1, m + 1), np.int32)
    rows[0] = 0
    along = np.empty(m, np.int32)
    for i, c in enumerate(item, 1):
        row, prev = rows[i], rows[i - 1]
        np.add(prev[:-1], steps[c], out=along)
        np.subtract(prev, gap, out=row)
        np.maximum(row[1:], along, out=row[1:])
        np.maximum.accumulate(row, out=row)
    i, j = n, m
    if not whole:
        i, j = map(int, np.unravel_index(int((rows - np.arange(m + 1, dtype=np.int32) * gap).argmax()), rows.shape))
    while i and j:
        v = int(rows[i, j])
        hit = item[i - 1] == region[j - 1]
        if v == rows[i - 1, j - 1] + gap + (same if hit else other):
            if hit:
                out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif v == rows[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return out


def placed(item: Item, text: str, first: int, last: int, pairs: list[tuple[int, int]]) -> list[int]:
    """For each character of the item, the place in the text that it is aligned with, or -1.

    Words found one behind the other hold; what is between such blocks is aligned, and what is missing
    at the ends as far as it goes.
    """
    blocks: list[list[int]] = []  # from, to in the item; place in the text
    for w, p in pairs:
        a, b = item.starts[w], item.ends[w]
        if blocks and blocks[-1][1] == a and blocks[-1][2] + a - blocks[-1][0] == p:
            blocks[-1][1] = b
        else:
            blocks.append([a, b, p])
    least = min(SOLID, max(b - a for a, b, _ in blocks))
    solid: list[list[int]] = []
    for block in blocks:
        if block[1] - block[0] >= least and (not solid or block[2] >= solid[-1][2] + solid[-1][1] - solid[-1][0]):
            solid.append(block)
    out = [-1] * len(item.text)
    for a, b, p in solid:
        out[a:b] = range(p, p + b - a)

    def fill(a: int, places: list[int], lo: int) -> None:
        out[a : a + len(places)] = [p + lo if p >= 0 else -1 for p in places]

    for (a, b, p), (c, _, q) in zip(solid, solid[1:]):
        fill(b, aligned(item.text[b:c], text[p + b - a : q]), p + b - a)
    (c, _, q), (a, b, p) = solid[0], solid[-1]
    begin, end, at = item.starts[first], item.ends[last], p + b - a
    fill(b, aligned(item.text[b:end], text[at : at + end - b + MARGIN], False), at)
    lo = max(0, q - (c - begin) - MARGIN)
    head = aligned(item.text[begin:c][::-1], text[lo:q][::-1], False)
    fill(begin, [q - lo - 1 - p if p >= 0 else -1 for p in head[::-1]], lo)
    return out


def longest_run(item: Item, places: list[int], cues: list[int], region: str) -> tuple[int, int, int]:
    """Words of the longest run, and the first and last place it is shown at (-1 if none)."""
    words = [[p for p in places[s:e] if p >= 0] for s, e in zip(item.starts, item.ends)]
    following = [0] * len(words)
    after = -1
    for k in range(len(words) - 1, -1, -1):
        following[k] = after
        after = words[k][0] if words[k] else after
    best, run, first, last, lost, before = (0, -1, -1), 0, -1, -1, 0, -1
    for at, s, e, number, after in zip(words, item.starts, item.ends, item.number, following):
        shown = len(at) > 0
        if number and shown:
            shown = len(at) == e - s == at[-1] - at[0] + 1 and not region[max(0, at[0] - 1) : at[0]].isdigit() and not region[at[-1] + 1 : at[-1] + 2].isdigit()
        elif shown:
            spread = at[-1] - at[0] + 1 - len(at)
            added = (at[0] - before - 1 if before >= 0 else 0) + (after - at[-1] - 1 if after >= 0 else 0)
            # a word that is damaged with much added beside it is another word
            shown = len(at) >= SHOWN * (e - s) and spread < 0.5 * (e - s) + 2 and (len(at) > 0.9 * (e - s) or added + spread <= OTHER)
        before = at[-1] if at else before
        if shown:
            added = at[0] - last - 1
            if run and (added > (2 if lost else MOST_ADDED) or cues[at[0]] - cues[last] > 1):
                run, first, lost = 0, -1, 0  # something else stands there
            run += lost + 1 if run else 1
            first = at[0] if first < 0 else first
            last, lost = at[-1], 0
            if run > best[0]:
                best = (run, first, last)
        elif run:
            lost += 1
            if lost > MOST_LOST:
                run, first, lost = 0, -1, 0
    return best


def shown_in(text: str, automaton: Automaton, least: int) -> list[tuple[object, int, int, int]]:
    """(item id, words, first character, last character) of each item that a document shows."""
    if not automaton.any:
        return []
    doc, out = Folded(text), []
    for k, hits in automaton.hits(doc.text).items():
        item, longest = automaton.items[k], (0, -1, -1)
        for first, last, pairs in automaton.standing(doc.text, k, hits):
            places = placed(item, doc.text, first, last, pairs)
            there = [p for p in places if p >= 0]
            lo, hi = min(there), max(there) + 1
            run = longest_run(item, [p - lo if p >= 0 else -1 for p in places], doc.cues(lo, hi), doc.text[lo:hi])
            if run[0] > longest[0]:
                longest = (run[0], lo + run[1], lo + run[2])
        if longest[0] >= least:
            out.append((item.item_id, longest[0], doc.offset(longest[1]), doc.offset(longest[2])))
    return out


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, words, char_start, char_end: the items that each document shows, once each."""
    rows = items.where(F.col(item_text).isNotNull()).select(item_id, item_text)
    total = rows.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"`{doc_id}` {kind[0]}, `{item_id}` {kind[1]}, words INT, char_start INT, char_end INT"
    context = docs.sparkSession.sparkContext
    block = F.pmod(F.xxhash64(item_id), F.lit(blocks))
    if blocks > 1:
        of = settled(map_arrow(rows.select(block.alias("_block"), item_text), _anchors, "_block BIGINT, anchor STRING"))
        many = of.groupBy("anchor").count().where(F.col("count") > SHARED)
    out: DataFrame | None = None
    for k in range(blocks):
        mine = rows.where(block == k).orderBy(item_id).collect()
        shared = set(of.where(F.col("_block") == k).join(many, "anchor", "left_semi").distinct().toArrow()["anchor"].to_pylist()) if blocks > 1 else None
        sent = context.broadcast(([tuple(r) for r in mine], shared))
        part = map_arrow(docs.where(F.col(text).isNotNull()).select(doc_id, text), _scan(sent, least), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def _anchors(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each anchor of an item once."""
    for b in parts(batches):
        rows = [(k, x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in set(anchors(Item(None, t)))]
        yield batch([list(c) for c in zip(*rows)] or [[], []], schema)


def _scan(sent, least: int):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        items, shared = sent.value
        automaton = Automaton(items, least, shared)
        for b in parts(batches):
            cols: list[list] = [[] for _ in schema]
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for found in shown_in(t, automaton, least):
                    for c, v in zip(cols, (rid, *found)):
                        c.append(v)
            yield batch(cols, schema)

    return run
