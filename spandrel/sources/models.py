"""Pluggable acoustic models and pronunciation: protocols, stand-ins, and an ONNX adapter.

The stand-ins are deterministic and make no claim of accuracy; they let every later stage run where
no trained model is at hand.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from spandrel.functions.arrow import batch, map_arrow, parts
from spandrel.operators import frames

#: A model takes windows (n, samples) and gives scores (n, frames, classes), or a mapping of heads to such.
Model = Callable[[np.ndarray], "np.ndarray | dict[str, np.ndarray]"]
#: Heads of a model: scores of phones, of groups, and vectors.
CLASSES, GROUPS, VECTORS = "classes", "groups", "vectors"


def stand_in_model(classes: int = 67, per_window: int = 10, groups: int = 0, dims: int = 0) -> Model:
    """Scores from the energy in bands of each frame; the same for the same samples.  Groups and vectors if asked for."""

    def predict(windows: np.ndarray) -> np.ndarray | dict[str, np.ndarray]:
        parts = windows[:, : windows.shape[1] // per_window * per_window].reshape(len(windows), per_window, -1)
        spectrum = np.abs(np.fft.rfft(parts, axis=2))
        bands = lambda n: np.log1p(spectrum[:, :, np.linspace(0, spectrum.shape[2] - 1, n).astype(int)]) * 4
        if not groups and not dims:
            return bands(classes)
        return {CLASSES: bands(classes)} | ({GROUPS: bands(groups)} if groups else {}) | ({VECTORS: bands(dims)} if dims else {})

    return predict


def onnx_model(path: str, outputs: dict[str, str] | str = "phoneme_logits", sample_input: str = "audio_window") -> Model:
    """An exported network, loaded once in each worker; outputs: a name, or the names by head.

    Where the path isn't on a worker's disk, the file that ``sent`` sent there is taken.
    """
    state: dict = {}

    def predict(windows: np.ndarray) -> np.ndarray | dict[str, np.ndarray]:
        if "session" not in state:
            import onnxruntime

            at = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
            state["session"] = onnxruntime.InferenceSession(at, providers=["CPUExecutionProvider"])
        given = {sample_input: windows.astype(np.float32)}
        if isinstance(outputs, str):
            return state["session"].run([outputs], given)[0]
        return dict(zip(outputs, state["session"].run(list(outputs.values()), given)))

    return predict


def sent(spark: SparkSession, path: str) -> str:
    """Sends a network's file, of any folder that Spark reads, to all workers; its path for ``onnx_model``."""
    spark.sparkContext.addFile(path)
    return path


def difference(model: Model, other: Model, windows: np.ndarray) -> float:
    """The largest absolute difference of two models' values over all heads, as between a network and its export."""
    a, b = ({CLASSES: x} if not isinstance(x, dict) else x for x in (model(windows), other(windows)))
    if set(a) != set(b):
        raise ValueError(f"different heads: {sorted(a)} and {sorted(b)}")
    return max(float(np.abs(np.asarray(a[h]) - np.asarray(b[h])).max()) for h in a)


def padded_windows(x: np.ndarray, window: int, stride: int) -> np.ndarray:
    """Windows that cover all samples, the last one filled up with zeros."""
    count = 1 + max(0, -(-(len(x) - window) // stride))
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, window + (count - 1) * stride - len(x))), window)[::stride]


def predicted(df: DataFrame, kept: list[str], samples: str, model: Model, window: int = 1920, stride: int = 1280, heads: tuple[str, ...] = (CLASSES,)) -> DataFrame:
    """The kept columns and, for each head, a column of its name: the values of each clip by frame, ARRAY<ARRAY<DOUBLE>>.

    A clip's windows are stitched in the task that made them, so that no frame is shuffled.  Clips are
    filled up with zeros to whole windows, so that short ones have a window too; frames beyond a
    clip's length are the caller's to cut.  Null and empty clips give no rows.
    """
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 16):
            rows, out = [], [[] for _ in heads]
            for i, x in enumerate(b.column(n).to_pylist()):
                if x:
                    scores = model(padded_windows(np.asarray(x, np.float64), window, stride))
                    scores = scores if isinstance(scores, dict) else {CLASSES: scores}
                    rows.append(i)
                    for column, head in zip(out, heads):
                        column.append(list(frames.stitched(np.asarray(scores[head], np.float64))))
            at = pa.array(rows, pa.int64())
            yield batch([*(b.column(k).take(at) for k in range(n)), *out], schema)

    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in kept)
    return map_arrow(df.select(*kept, samples), run, ", ".join([ddl, *(f"{h} ARRAY<ARRAY<DOUBLE>>" for h in heads)]))


#: Fixed values of the stand-in pronunciation: phones of letters and letter pairs.
GRAPHEMES = {
    "sh": "ʃ", "ch": "tʃ", "th": "θ", "ng": "ŋ", "ee": "i:", "oo": "u:", "a": "æ", "b": "b", "c": "k", "d": "d", "e": "ɛ", "f": "f", "g": "ɡ", "h": "h", "i": "ɪ",
    "j": "dʒ", "k": "k", "l": "l", "m": "m", "n": "n", "o": "ɑ", "p": "p", "q": "k", "r": "ɹ", "s": "s", "t": "t", "u": "ʌ", "v": "v", "w": "w", "x": "s", "y": "j", "z": "z",
}


def phones(word: str) -> list[str]:
    """Phones of a word by its letters; 'noise' for other characters."""
    out, i, w = [], 0, word.lower()
    while i < len(w):
        if w[i : i + 2] in GRAPHEMES:
            out.append(GRAPHEMES[w[i : i + 2]])
            i += 2
        else:
            out.append(GRAPHEMES.get(w[i], "noise"))
            i += 1
    return out


def pronounced(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """keys, word_idx, word, phone_idx, phone: a row per phone of each word, trimmed and canonically composed; a pause is one SIL."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in parts(batches):
            rows = []
            for i, ws in enumerate(b.column(n).to_pylist()):
                for j, w in enumerate(ws or []):
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = ["SIL"] if w == "<SIL>" else [unicodedata.normalize("NFC", p.strip()) for p in phones(w)]
                    rows.extend((i, j, w, k, p) for k, p in enumerate(known[w]))
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(5)]
            at = pa.array(cols[0], pa.int64())
            yield batch([*(b.column(k).take(at) for k in range(n)), *cols[1:]], schema)

    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return map_arrow(df.select(*keys, words), run, f"{ddl}, word_idx INT, word STRING, phone_idx INT, phone STRING")
