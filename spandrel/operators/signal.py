"""Signal transforms over one clip's samples: resampling and mel spectra, by numpy in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spandrel.functions.arrow import batch, map_arrow


@lru_cache(8)
def mel_filters(rate: int, n_fft: int, n_mels: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale that is linear up to 1 kHz, of equal area."""
    knee, step = 1000.0, 200.0 / 3
    log_step = np.log(6.4) / 27
    to_mel = lambda f: f / step if f < knee else knee / step + np.log(f / knee) / log_step
    mels = np.linspace(to_mel(low), to_mel(high), n_mels + 2)
    hz = np.where(mels < knee / step, mels * step, knee * np.exp(log_step * (mels - knee / step)))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[None, :] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins[None, :]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def mel_spectrum(x: np.ndarray, rate: int = 22_050, n_fft: int = 1024, hop: int = 256, n_mels: int = 80, low: float = 0.0, high: float = 8000.0) -> np.ndarray:
    """Log mel magnitudes (frames, mels); samples are mirrored at both ends."""
    pad = (n_fft - hop) // 2
    if len(x) <= pad:
        return np.zeros((0, n_mels))
    x = np.pad(x, pad, mode="reflect")
    if len(x) < n_fft:
        return np.zeros((0, n_mels))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    spectrum = np.fft.rfft(frames * window, axis=1)
    magnitude = np.sqrt(spectrum.real**2 + spectrum.imag**2 + 1e-9)
    return np.log(np.maximum(magnitude @ mel_filters(rate, n_fft, n_mels, low, high).T, 1e-5))


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation at the target rate."""
    if source == target or not len(x):
        return x
    at = np.arange(int(len(x) * target / source)) * (source / target)
    return np.interp(at, np.arange(len(x)), x)


#: Fixed values of the band-limited resampler: zero crossings on each side, cut-off as a part of the lower rate's band, shape of the window.
CROSSINGS, ROLLOFF, SHAPE = 64, 0.9475937167399596, 14.769656459379492


def band_limited(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Samples at the target rate by a windowed sinc (Kaiser); unchanged at equal rates.

    Each output phase has its own filter; phases repeat with the reduced ratio of the rates.
    """
    if not len(x) or source == target:
        return x
    div = math.gcd(source, target)
    old, new = source // div, target // div
    cut = min(old, new) * ROLLOFF
    reach = math.ceil(CROSSINGS * old / cut)
    n = -(-len(x) * new // old)
    at = np.arange(-reach, reach + old) / old
    padded = np.pad(x, (reach, reach + old))
    out = np.zeros((-(-len(x) // old), new))
    for phase in range(new):
        t = np.clip((at - phase / new) * cut, -CROSSINGS, CROSSINGS)
        taps = np.sinc(t) * np.i0(SHAPE * np.sqrt(1 - (t / CROSSINGS) ** 2)) / np.i0(SHAPE) * cut / old
        frames = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[::old][: len(out)]
        out[: len(frames), phase] = frames @ taps
    return out.ravel()[:n]


def mel_frames(df: DataFrame, key: str, samples: str, **settings) -> DataFrame:
    """key, frame, mel, value of each clip; clips too short for a frame give no rows."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(1).to_pylist()):
                m = mel_spectrum(np.asarray(x or [], np.float64), **settings)
                if len(m):
                    t, k = np.indices(m.shape)
                    yield batch([b.column(0).take(pa.array(np.full(m.size, i))), t.ravel().astype(np.int32), k.ravel().astype(np.int32), m.ravel()], schema)

    return map_arrow(df.select(key, samples), run, f"`{key}` {df.schema[key].dataType.simpleString()}, frame INT, mel INT, value DOUBLE")
