"""Languages of documents and of each stretch of a mixed one, with a confidence.

Each word of the dialogue gets a score for every language: for words of the labelled sample, from
their counts; for others, from their letter trigrams, within narrower bounds, as most are names or
damaged.  The script of a word narrows the languages to those whose sample is written in it; a word
in a script of no language is undetermined.  A Viterbi pass over the words, with a penalty for
changing language, labels them; spans of equal labels are the stretches.

The Viterbi pass runs over many documents at once, one word of each at a step.

The model is fitted on the labelled sample, which is collected to the driver: at most MOST_SAMPLES
rows, else it is refused.  Everything else covers all documents and whole texts.

Defined results: null and empty texts, and texts without a word, have no language and no row;
undetermined stretches are labelled 'und'; on ties the language first in the alphabet is taken;
repeated rows are documents each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, map_arrow, parts
from spandrel.llm import subtitles

#: Rows of the labelled sample at most.
MOST_SAMPLES = 100_000
#: Bounds of a word's score below the best language, for words of the sample and others; the penalty for a change.
KNOWN, OTHER, CHANGE = 5.0, 1.0, 9.0
#: Scores of the undetermined state: for words in a known script, and of the languages for words in no known one.
UND, FOREIGN = -5.0, -9.0
#: Cells of a group of documents that the Viterbi pass takes at once, and words that a worker remembers.
CELLS, REMEMBERED = 2_000_000, 500_000

_WORD = re.compile(r"[^\W\d_]+")

#: Other codes and names of the languages, by their code.
CODES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français", "es": "spa spanish español castellano",
    "pt": "por portuguese português", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "pl": "pol polish polski",
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "undetermined", "unknown", "none", "null", "mul", "mis", "zxx", "xx", "n", "?")


def _composed(line: str) -> str:
    return line if line.isascii() else unicodedata.normalize("NFC", line.translate(subtitles.INVISIBLE))


def words_of(text: str) -> list[str]:
    """The words of the dialogue, in lower case."""
    return _WORD.findall(_composed("\n".join(subtitles.spoken(text))).lower())


def word_offsets(text: str) -> list[tuple[int, int]]:
    """First and end character of each of words_of(text).

    In lines with invisible characters or uncomposed letters, words have their places in the composed
    line, cut off at the line's end.
    """
    out, begin = [], 0
    for line, own in zip(subtitles.spoken(text), subtitles.file_lines(text)):
        places = [*subtitles.ungarbled_places(own), len(own)]
        right = _composed(line).lower()
        last = len(places) - 1
        out.extend((begin + places[min(m.start(), last)], begin + places[min(m.end(), last)]) for m in _WORD.finditer(right))
        begin += len(own) + 1
    return out


def script(word: str) -> str:
    """The script of a word's first letter; Latin by its range, others by name."""
    c = word[0]
    return "LATIN" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else unicodedata.name(c, "?").split(" ", 1)[0]


class Model:
    """Scores of words for each language, of the last column for 'und'."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        n = len(self.langs)
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        grams: list[Counter] = [Counter() for _ in range(n)]
        self.scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n, bool))
        for lang, text in samples:
            k = self.langs.index(lang)
            for w in _WORD.findall(unicodedata.normalize("NFC", text).lower()):
                counts[w][k] += 1
                self.scripts[script(w)][k] = True
        for w, c in counts.items():
            for k in np.flatnonzero(c):
                for g in self.grams(w):
                    grams[k][g] += 1
        total = np.array([sum(c[k] for c in counts.values()) for k in range(n)]) if n else np.zeros(0)
        self.known = {w: self.bounded(np.log((c + 0.3) / (total + 0.3 * len(counts))), KNOWN) for w, c in counts.items()}
        kinds = len(set().union(*grams)) if grams else 1
        sums = [sum(g.values()) for g in grams]
        self.gram = {g: np.log((np.array([c[g] for c in grams]) + 0.2) / (np.array(sums) + 0.2 * kinds)) for g in set().union(*grams)} if grams else {}
        self.scripts = dict(self.scripts)

    @staticmethod
    def grams(word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    @staticmethod
    def bounded(log: np.ndarray, most: float) -> np.ndarray:
        return np.maximum(log - log.max(), -most)

    def score(self, word: str) -> np.ndarray:
        n = len(self.langs)
        can = self.scripts.get(script(word))
        out = np.full(n + 1, UND)
        if can is None:
            out[:n], out[n] = FOREIGN, 0.0
            return out
        if (known := self.known.get(word)) is not None:
            out[:n] = known
        else:
            seen = [self.gram[g] for g in self.grams(word) if g in self.gram]
            out[:n] = self.bounded(np.sum(seen, axis=0) / math.sqrt(len(seen)), OTHER) if seen else 0.0
        out[:n][~can] = FOREIGN
        return out


class Scorer:
    """Words to rows of a matrix of scores, remembered."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, []
        self.matrix = np.zeros((0, len(model.langs) + 1), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        out = np.array([index.get(w, -1) for w in words], np.int32)
        if out.size and out.min() < 0:
            for w in words:
                if w not in index:
                    index[w] = len(self.rows)
                    self.rows.append(self.model.score(w).astype(np.float32))
            out = np.array([index[w] for w in words], np.int32)
        return out

    def scores(self) -> np.ndarray:
        if len(self.matrix) < len(self.rows):
            self.matrix = np.array(self.rows)
        return self.matrix

    def forget(self) -> None:
        if len(self.rows) > REMEMBERED:
            self.index, self.rows, self.matrix = {}, [], self.matrix[:0]


def viterbi(docs: list[np.ndarray], scores: np.ndarray, change: float = CHANGE) -> list[np.ndarray]:
    """Best state of each word of each document; docs must not be empty and be in falling order of length."""
    lengths = np.array([len(d) for d in docs])
    longest, n, s = int(lengths[0]), len(docs), scores.shape[1]
    ids = np.zeros((longest, n), np.int32)
    for k, d in enumerate(docs):
        ids[: len(d), k] = d
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents that have a word at each step
    value = scores[ids[0]].astype(np.float64)
    came = np.zeros((longest, n), np.uint8)  # best state before the step
    changed = np.zeros((longest, n, s), bool)
    for t in range(1, longest):
        a = active[t]
        v = value[:a]
        best = v.argmax(axis=1)
        other = v[np.arange(a), best] - change
        changed[t, :a] = v < other[:, None]
        came[t, :a] = best
        value[:a] = np.maximum(v, other[:, None]) + scores[ids[t, :a]]
    state = value.argmax(axis=1)
    path = np.zeros((longest, n), np.uint8)
    every = np.arange(n)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        path[t, :a] = state[:a]
        if t:
            jump = changed[t, every[:a], state[:a]]
            state[:a] = np.where(jump, came[t, :a], state[:a])
    return [path[: len(d), k] for k, d in enumerate(docs)]


def labelled(texts: list[str | None], scorer: Scorer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, its words' scores, their states) of each text with a word."""
    scorer.forget()
    docs = [(i, ids) for i, t in enumerate(texts) if t and len(ids := scorer.ids(words_of(t)))]
    docs.sort(key=lambda d: -len(d[1]))
    scores = scorer.scores()
    at = 0
    while at < len(docs):
        take = max(1, CELLS // len(docs[at][1]))
        group = docs[at : at + take]
        for (i, ids), path in zip(group, viterbi([d for _, d in group], scores)):
            yield i, scores[ids], path
        at += take


def confidence(scores: np.ndarray, state: int) -> float:
    """How much more likely the words are in their language than in the next best, between 0 and 1."""
    total = scores.sum(axis=0, dtype=np.float64)
    rest = np.delete(total, state).max()
    return float(1 / (1 + math.exp(-max(-500.0, min(500.0, (total[state] - rest) / 4)))))


def fitted(samples: DataFrame, lang: str, text: str) -> Model:
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError("the labelled sample is too large; pass fewer rows")
    return Model(sorted(tuple(r) for r in rows))


def document_languages(df: DataFrame, doc_id: str, text: str, model: Model, keep: list[str] = (), least_share: float = 0.1) -> DataFrame:
    """doc_id, the kept columns, lang, share, words, confidence, spoken: a row for each language of a document.

    spoken: the document's languages, in order, that make up at least ``least_share`` of its words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [doc_id, *keep]

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = [*shared.value.langs, "und"]
        for b in parts(batches):
            cols: list[list] = [[] for _ in range(6)]
            for i, scores, path in labelled(b.column(len(columns)).to_pylist(), scorer):
                n = np.bincount(path, minlength=len(names))
                spoken = [x for k, x in enumerate(names[:-1]) if n[k] >= least_share * len(path) and n[k]]
                for k in np.flatnonzero(n):
                    for c, v in zip(cols, (i, names[k], n[k] / len(path), int(n[k]), confidence(scores[path == k], k), spoken)):
                        c.append(v)
            rows = pa.array(cols[0], pa.int64())
            yield batch([*(b.column(j).take(rows) for j in range(len(columns))), *cols[1:]], schema)

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", lang STRING, share DOUBLE, words BIGINT, confidence DOUBLE, spoken ARRAY<STRING>"
    rows = df.where(F.col(text).isNotNull()).select(*columns, text)
    if "lang" in keep:
        rows, ddl = rows.withColumnRenamed("lang", "label"), ddl.replace("`lang`", "`label`")
    return map_arrow(rows, run, ddl)


def language_spans(df: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """doc_id, span, first_word, words, char_start, char_end, lang, confidence: each stretch of each document, in order."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = [*shared.value.langs, "und"]
        for b in parts(batches):
            cols: list[list] = [[] for _ in range(8)]
            texts = b.column(1).to_pylist()
            for i, scores, path in labelled(texts, scorer):
                at = word_offsets(texts[i])
                starts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                for span, (s, e) in enumerate(zip(starts, np.append(starts[1:], len(path)))):
                    for c, v in zip(cols, (i, span, int(s), int(e - s), at[s][0], at[e - 1][1], names[path[s]], confidence(scores[s:e], int(path[s])))):
                        c.append(v)
            yield batch([b.column(0).take(pa.array(cols[0], pa.int64())), *cols[1:]], schema)

    return map_arrow(df.where(F.col(text).isNotNull()).select(doc_id, text), run, f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, span INT, first_word INT, words INT, char_start INT, char_end INT, lang STRING, confidence DOUBLE")


def named_languages(label: Column) -> Column:
    """The sorted codes of the languages that a label names: regions, other codes and names are understood."""
    same = {other: code for code, others in CODES.items() for other in others.split()}
    table = F.create_map(*(F.lit(x) for pair in sorted(same.items()) for x in pair))
    parts = F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[,;/|+&\s]+")
    codes = F.transform(parts, lambda p: F.regexp_extract(p, r"^([^-_]*)", 1))
    codes = F.transform(codes, lambda p: F.coalesce(table[p], p))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda p: ~p.isin(*NO_LANGUAGE))))


def wrong_labels(languages: DataFrame, doc_id: str, label: str) -> DataFrame:
    """doc_id, lang, once each: the languages spoken in documents whose label doesn't name exactly these; only these rows are shuffled."""
    wrong = F.array_contains("spoken", F.col("lang")) & (named_languages(F.col(label)) != F.col("spoken"))
    return languages.where(wrong).select(doc_id, "lang").distinct()
