"""Clips of sound: WAV files decoded by numpy in Arrow batches, one row per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spandrel.functions.arrow import batch, map_arrow
from spandrel.operators.signal import band_limited


def decoded_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of 16-bit or 32-bit float PCM; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, kind, channels, rate, bits = 12, 0, 0, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", data, at + 8)
            bits = struct.unpack_from("<H", data, at + 22)[0]
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
            if kind == 3 and bits == 32:
                x = np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float64)
            elif bits == 16:
                x = np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0
            else:
                raise ValueError(f"{bits} bits of format {kind} aren't supported")
            x = x[: len(x) // channels * channels]
            return rate, x.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def clips_of(spark: SparkSession, given, rate: int | None = None, target: int = 16_000) -> DataFrame:
    """clip_id, samples ARRAY<FLOAT> from arrays in memory: one or several 1-D or 2-D (channels, samples), one 3-D (clips, channels, samples), or a dict of them by clip_id.

    Channels are averaged.  The rate must be stated for arrays; clips without an id are named by their
    place.  Empty clips are kept, without samples.
    """
    if rate is None:
        raise ValueError("arrays need their sample rate")
    if isinstance(given, dict):
        named = list(given.items())
    else:
        x = [np.asarray(g, np.float64) for g in given] if isinstance(given, (list, tuple)) and given and np.ndim(given[0]) else [np.asarray(given, np.float64)]
        named = list(enumerate(x[0] if len(x) == 1 and x[0].ndim == 3 else x))
    rows = []
    for name, x in named:
        x = np.atleast_2d(np.asarray(x, np.float64))
        if x.ndim != 2:
            raise ValueError(f"clip {name} has {x.ndim} dimensions")
        rows.append((str(name), band_limited(x.mean(axis=0), rate, target).astype(np.float32).tolist() if x.size else []))
    return spark.createDataFrame(rows, "clip_id STRING, samples ARRAY<FLOAT>")


def paired(clips: DataFrame, transcripts: DataFrame, key: str = "clip_id") -> DataFrame:
    """clips with their transcripts; an error names a batch whose sizes don't match."""
    c, t = clips.select(key).distinct().count(), transcripts.select(key).distinct().count()
    joined = clips.join(transcripts, key)
    if not c == t == joined.select(key).distinct().count():
        raise ValueError(f"batch size mismatch: {c} clips, {t} transcripts")
    return joined


def read_wav(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """path, source_rate, samples ARRAY<FLOAT> at the given rate, error."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    source, x = decoded_wav(data)
                    row = [[name], [source], [band_limited(x, source, rate).astype(np.float32).tolist()], [None]]
                except (ValueError, struct.error, ZeroDivisionError) as e:
                    row = [[name], [None], [None], [str(e)]]
                yield batch(row, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, run, "path STRING, source_rate INT, samples ARRAY<FLOAT>, error STRING")
