"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch of a group is a set of sorted buffers of K values with a weight (a power of two), and fewer
than K values of weight one that fill no buffer yet.  Two full buffers of the same weight collapse
into one of twice the weight: their values are merged and every other one is kept, from the first or
the second in turn.  A collapse of buffers of weight w moves any rank by at most w; the sketch sums
these up in ``err``, a proven bound on its own rank error.  As buffers collapse only with their like,
collapses form a balanced tree and err is at most n * log2(n / K) / (2 K): with K = 4096, 0.35 % of
the ranks for 10**12 values.  Up to K values, results are exact.

Sketches are mergeable: of tasks, of salts, of days.  Every scan task sketches its own rows before
anything is shuffled, so that a group that holds most rows shuffles no more than any other; partial
sketches meet first in FAN_IN salted groups, then in one.

Defined results: null, NaN and values outside the stated range are left out; ties and repeated rows
count as often as they come; a null group is a group; groups without a value and empty tables give no
rows.  A percentile q is the value of rank ceil(q * n), at least 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, combined, map_arrow

#: Values of a buffer.
K = 4096
#: Salted groups that partial sketches of a group meet in first.
FAN_IN = 16
#: Values that a task's unfinished sketches may hold before they are sent on.
HELD = 4_000_000


class Sketch:
    """Weighted sorted buffers of one group."""

    __slots__ = ("k", "n", "err", "loose", "n_loose", "full", "turn")

    def __init__(self, k: int = K):
        self.k, self.n, self.err, self.loose, self.n_loose, self.full, self.turn = k, 0, 0, [], 0, {}, 0

    def add(self, values: np.ndarray) -> None:
        """Values of weight one."""
        self.n += len(values)
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            all_ = np.concatenate(self.loose)
            whole = len(all_) // self.k * self.k
            for i in range(0, whole, self.k):
                self._buffer(1, np.sort(all_[i : i + self.k]))
            self.loose, self.n_loose = [all_[whole:]], len(all_) - whole

    def _buffer(self, weight: int, values: np.ndarray) -> None:
        while (other := self.full.pop(weight, None)) is not None:
            both = np.concatenate((other, values))
            both.sort(kind="stable")  # a merge of two runs
            values = both[self.turn :: 2]
            self.turn ^= 1
            self.err += weight
            weight *= 2
        self.full[weight] = values

    def merge(self, n: int, err: int, buffers: Sequence[tuple[int, np.ndarray]]) -> None:
        """Another sketch's count, error and buffers; those of weight one and fewer than k values are its loose ones."""
        self.err += err
        for weight, values in buffers:
            if weight == 1 and len(values) < self.k:
                self.add(values)
                self.n -= len(values)
            else:
                self._buffer(weight, values)
        self.n += n

    def buffers(self) -> list[tuple[int, np.ndarray]]:
        loose = [(1, np.sort(np.concatenate(self.loose)))] if self.n_loose else []
        return loose + sorted(self.full.items(), key=lambda b: b[0])

    def quantiles(self, at: Sequence[float]) -> list[float]:
        buffers = self.buffers()
        values = np.concatenate([v for _, v in buffers])
        weights = np.concatenate([np.full(len(v), w, np.int64) for w, v in buffers])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        wanted = np.maximum(1, np.ceil(np.asarray(at) * self.n - 1e-9)).astype(np.int64)
        return values[order][np.minimum(np.searchsorted(ranks, wanted), len(values) - 1)].tolist()


_STATE = "n BIGINT, err BIGINT, weights ARRAY<BIGINT>, sizes ARRAY<INT>, vals ARRAY<DOUBLE>"


def _rows(groups: list[tuple[tuple, Sketch]], schema: pa.Schema) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in schema]
    for key, s in groups:
        b = s.buffers()
        for c, v in zip(cols, (*key, s.n, s.err, [w for w, _ in b], [len(v) for _, v in b], np.concatenate([v for _, v in b]))):
            c.append(v)
    return batch(cols, schema)


def _partial(n_keys: int, k: int):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = [combined(b.column(i)).dictionary_encode() for i in range(n_keys)]
            values = np.asarray(b.column(n_keys))
            parts = [np.asarray(pc.fill_null(d.indices, -1)).astype(np.int64) for d in keys]
            names = [[*d.dictionary.to_pylist(), None] for d in keys]
            order = np.lexsort(tuple(reversed(parts)))
            new = np.zeros(len(order), bool)
            new[0] = True
            for p in parts:
                s = p[order]
                new[1:] |= s[1:] != s[:-1]
            bounds = [*np.flatnonzero(new).tolist(), len(order)]
            for i, j in zip(bounds, bounds[1:]):
                key = tuple(n[p[order[i]]] for n, p in zip(names, parts))
                if (s := held.get(key)) is None:
                    s = held[key] = Sketch(k)
                s.add(values[order[i:j]])
            size += b.num_rows
            if size > HELD and sum(s.n_loose + k * len(s.full) for s in held.values()) > HELD:
                yield _rows(list(held.items()), schema)
                held, size = {}, 0
        if held:
            yield _rows(list(held.items()), schema)

    return run


def _combine(n_keys: int, k: int, wanted: Sequence[float] | None = None, salt: bool = False):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Input sorted by key and, if there is one, by the salt in its last column."""

        def out(groups: list[tuple[tuple, Sketch]]) -> pa.RecordBatch:
            if wanted is None:
                return _rows(groups, schema)
            rows = [(*key, s.n, s.err, *s.quantiles(wanted)) for key, s in groups]
            return batch([list(c) for c in zip(*rows)], schema)

        key, sketch, done, size = None, None, [], 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(n_keys + 2)]
            weights, sizes = (b.column(n_keys + i).to_pylist() for i in (2, 3))
            salts = b.column(n_keys + 5).to_pylist() if salt else []
            vals = b.column(n_keys + 4)
            flat, offsets = np.asarray(vals.values), np.asarray(vals.offsets)
            for r in range(b.num_rows):
                own = (*(c[r] for c in cols[:n_keys]), *salts[r : r + 1])
                if sketch is None or own != key:
                    if sketch is not None:
                        done.append((key[:n_keys], sketch))
                        size += sketch.n_loose + k * len(sketch.full)
                        if size > HELD:
                            yield out(done)
                            done, size = [], 0
                    key, sketch = own, Sketch(k)
                ends = (offsets[r] + np.cumsum([0, *sizes[r]])).tolist()
                sketch.merge(cols[n_keys][r], cols[n_keys + 1][r], [(w, flat[i:j]) for w, i, j in zip(weights[r], ends, ends[1:])])
        if sketch is not None:
            done.append((key[:n_keys], sketch))
        if done:
            yield out(done)

    return run


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def sketches(df: DataFrame, keys: list[str], value: Column, low: float | None = None, high: float | None = None, k: int = K) -> DataFrame:
    """Sketches by keys: one row for each group, to be stored, merged or asked."""
    v = value.cast("double")
    good = v.isNotNull() & ~F.isnan(v)
    for bound, test in ((low, v.__ge__), (high, v.__le__)):
        good = good & test(bound) if bound is not None else good
    rows = df.where(good).select(*keys, v.alias("_v"))
    return merge_sketches(map_arrow(rows, _partial(len(keys), k), f"{_ddl(df, keys)}, {_STATE}"), keys, k)


def merge_sketches(parts: DataFrame, keys: list[str], k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Sketches by keys from sketches by these and any other keys."""
    ddl = f"{_ddl(parts, keys)}, {_STATE}"
    parts = parts.select(*keys, "n", "err", "weights", "sizes", "vals")
    order = [*keys, "n", "err", "weights", "vals"]
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("n", "err", "vals"), F.lit(fan_in))).repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", *order[len(keys) :])
    first = map_arrow(salted, _combine(len(keys), k, salt=True), ddl)
    return map_arrow(first.repartition(*keys).sortWithinPartitions(*order), _combine(len(keys), k), ddl)


def percentiles(merged: DataFrame, keys: list[str], at: dict[str, float], k: int = K) -> DataFrame:
    """keys, n, rank_error and a column for each percentile, of sketches that have one row for each group."""
    ddl = f"{_ddl(merged, keys)}, n BIGINT, rank_error BIGINT, " + ", ".join(f"`{c}` DOUBLE" for c in at)
    return map_arrow(merged.select(*keys, "n", "err", "weights", "sizes", "vals"), _combine(len(keys), k, list(at.values())), ddl)


def ranks(df: DataFrame, keys: list[str], value: Column, asked: DataFrame, at: Sequence[str]) -> DataFrame:
    """asked with below_x and to_x for each percentile x: how many values of the group are below it, and not above it."""
    names = [f"_k{i}" for i in range(len(keys))]
    p = asked.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *at)
    on = None
    rows = df.select(*keys, value.alias("_v"))
    for k, n in zip(keys, names):
        on = rows[k].eqNullSafe(p[n]) if on is None else on & rows[k].eqNullSafe(p[n])
    counts = [F.sum((F.col("_v") < F.col(x)).cast("long")).alias(f"below_{x}") for x in at] + [F.sum((F.col("_v") <= F.col(x)).cast("long")).alias(f"to_{x}") for x in at]
    return rows.join(p, on).groupBy(*names).agg(*counts).select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *(f"below_{x}" for x in at), *(f"to_{x}" for x in at))
