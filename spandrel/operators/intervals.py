"""Union of time intervals per entity, its continuous periods and its gaps.

The operator is a mergeable aggregate.  Its state for one entity and one slice of the timeline is a
pair of equally long sorted lists (starts, ends) of disjoint intervals.  States are combined by a
linear merge of their sorted lists, in a reduction tree:

1. every scan task reduces its own rows to partial states, before anything is shuffled;
2. partial states meet in up to FAN_IN salted groups of an (entity, slice);
3. the salted groups meet, one group per (entity, slice);
4. slices of an entity are stitched with a running maximum over one narrow row (slice, latest end) per
   slice, which is joined to the lists by slice.

A hot entity is thus split over the scan tasks, over salts and over slices; no task holds more than
one slice's disjoint intervals, whose number is bounded by the slice's length and not by the rows.
States of separate loads can be stored and combined later with ``combine_states``.

Defined results: rows whose start or end is null, NaN or infinite, or whose end is not after the
start, are left out.  Times are whole microseconds, ties to even.  Intervals that touch are joined.
Repeated rows change nothing.  Null keys form an entity of their own.  An empty table gives no rows.
Columns of the input other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, combined, map_arrow

#: Length of a slice of the timeline in microseconds (about 67 s); at most 2**27.
SLICE_US = 1 << 26
#: Salted groups that partial states of one (entity, slice) meet in first.
FAN_IN = 16
#: Rows that a task reduces at a time.
ROWS_AT_ONCE = 262_144


def disjoint(code: np.ndarray, start: np.ndarray, end: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of each code from any intervals; sorted by code and start.

    within: the starts' places in their slices, less than 2**27.  The stable sort of one integer finds
    the runs that are in order and merges them, so that sorted lists are merged in linear time.
    """
    n = len(start)
    if n == 0:
        return code, start, end
    key = (code << 27) | within
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        code, start, end = code[order], start[order], end[order]
    first = np.append(True, code[1:] != code[:-1])
    # running maximum of the ends within a code, over 2, 4, 8 ... rows
    top, longest, step = end, int(np.diff(np.append(np.flatnonzero(first), n)).max()), 1
    while step < longest:
        same = code[step:] == code[:-step]
        top = np.concatenate((top[:step], np.where(same, np.maximum(top[step:], top[:-step]), top[step:])))
        step *= 2
    opens = first
    opens[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(opens)
    last = np.append(at[1:] - 1, n - 1)
    return code[at], start[at], top[last]


def _states(keys: list[pa.Array], at: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray, slice_no: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of states: at has one input row for each code, to take its keys from."""
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    offsets = pa.array(np.append(heads, len(code)), pa.int32())
    rows = pa.array(at[code[heads]])
    return batch(
        [*(k.take(rows) for k in keys), slice_no[code[heads]], pa.ListArray.from_arrays(offsets, pa.array(start)), pa.ListArray.from_arrays(offsets, pa.array(end))],
        schema,
    )


def _codes(keys: list[pa.Array], slice_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of rows by key and slice, and a row of each group."""
    parts = [np.asarray(pc.fill_null(k.dictionary_encode().indices, -1)).astype(np.int64) for k in keys]
    order = np.lexsort((slice_no, *reversed(parts)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for p in (*parts, slice_no):
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, order[new]


def _partial(n_keys: int, slice_us: int):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            keys = [combined(t.column(i)) for i in range(n_keys)]
            start, end = (np.asarray(combined(t.column(n_keys + i))) for i in (0, 1))
            slices = np.floor_divide(start, slice_us)
            code, at = _codes(keys, slices)
            return _states(keys, at, *disjoint(code, start, end, start - slices * slice_us), slices[at], schema)

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= ROWS_AT_ONCE:
                yield reduced(held)
                held, rows = [], 0
        if held:
            yield reduced(held)

    return run


def _combine(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Input sorted by key and slice; the last group of a batch waits for the next batch."""
        waiting: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b.select(list(range(n_keys + 3)))])
            waiting = pa.concat_tables([waiting, t.rename_columns(waiting.column_names)]) if waiting is not None else t
            done = _merged(waiting, n_keys, schema)
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
            waiting = pa.Table.from_batches([done.slice(done.num_rows - 1)])
        if waiting is not None:
            yield from waiting.to_batches()

    return run


def _merged(t: pa.Table, n_keys: int, schema: pa.Schema) -> pa.RecordBatch:
    keys = [combined(t.column(i)) for i in range(n_keys)]
    slices = np.asarray(combined(t.column(n_keys)))
    starts, ends = (combined(t.column(n_keys + i)) for i in (1, 2))
    parts = [np.asarray(pc.fill_null(k.dictionary_encode().indices, -1)) for k in keys]
    new = np.zeros(len(slices), bool)
    new[:1] = True
    for p in (*parts, slices):
        new[1:] |= p[1:] != p[:-1]
    at = np.flatnonzero(new)
    code = np.repeat(np.cumsum(new) - 1, np.asarray(pc.list_value_length(starts)))
    start = np.asarray(starts.flatten())
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else at
    own = np.minimum.reduceat(start, heads)[code] if len(code) else start  # a slice is no longer than 2**27
    return _states(keys, at, *disjoint(code, start, np.asarray(ends.flatten()), start - own), slices[at], schema)


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", slice BIGINT, starts ARRAY<BIGINT>, ends ARRAY<BIGINT>"


def interval_states(df: DataFrame, keys: list[str], start_ms: Column, end_ms: Column, slice_us: int = SLICE_US) -> DataFrame:
    """The aggregate's states: keys, slice, starts, ends; one row per key and slice."""
    if not 0 < slice_us <= 1 << 27:
        raise ValueError("a slice has 1 to 2**27 microseconds")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 9e15)
    s, e = start_ms.cast("double"), end_ms.cast("double")
    rows = df.where(finite(s) & finite(e) & (e > s)).select(*keys, F.rint(s * 1000).cast("long").alias("_s"), F.rint(e * 1000).cast("long").alias("_e"))
    return combine_states(map_arrow(rows, _partial(len(keys), slice_us), _ddl(df, keys)), keys)


def combine_states(states: DataFrame, keys: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """One state per key and slice from any number of them; associative and commutative."""
    ddl = _ddl(states, keys)
    order = [*keys, "slice"]
    salted = states.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    first = map_arrow(salted.repartition(*order, "_salt").sortWithinPartitions(*order), _combine(len(keys)), ddl)
    return map_arrow(first.repartition(*order).sortWithinPartitions(*order), _combine(len(keys)), ddl)


def _stitched(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, gaps: of each slice its gaps as (gap_start, gap_end), also the one before its first interval; that of a key's first slice has no start.

    Only keys, slice and latest end go through the window over a whole key; the lists are joined to it by slice.
    """
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = states.select(*keys, "slice", F.element_at("ends", -1).alias("_end"))
    narrow = narrow.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("slice").alias("_s"), F.max("_end").over(before).alias("_carry"))
    on = states["slice"] == narrow["_s"]
    for k, n in zip(keys, names):
        on = on & states[k].eqNullSafe(narrow[n])
    pairs = F.zip_with(
        F.concat(F.array(F.col("_carry")), F.slice("ends", F.lit(1), F.size("ends") - 1)),
        F.col("starts"),
        lambda end, start: F.struct(F.greatest(end, F.col("_carry")).alias("gap_start"), start.alias("gap_end")),
    )
    gaps = F.filter(pairs, lambda p: p["gap_start"].isNull() | (p["gap_end"] > p["gap_start"]))
    return states.join(narrow, on).select(*(states[k] for k in keys), "slice", "ends", gaps.alias("gaps"))


def interval_gaps(states: DataFrame, keys: list[str], min_gap_us: int = 1) -> DataFrame:
    """keys, gap_start_us, gap_end_us of every uncovered stretch of at least min_gap_us between two covered instants."""
    gap = F.explode(F.filter("gaps", lambda p: p["gap_end"] - p["gap_start"] >= min_gap_us)).alias("_g")
    return _stitched(states, keys).select(*keys, gap).select(*keys, F.col("_g.gap_start").alias("gap_start_us"), F.col("_g.gap_end").alias("gap_end_us"))


def covered_periods(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, period_start_us, period_end_us of every continuous covered period.

    A period between two gaps of one slice is made there; of those that go on into other slices only
    the ends of the slices' gaps meet in a window, a row for each slice.
    """
    s = _stitched(states, keys)
    inside = F.zip_with(F.col("gaps"), F.slice("gaps", F.lit(2), F.greatest(F.size("gaps") - 1, F.lit(0))), lambda a, b: F.struct(a["gap_end"].alias("a"), b["gap_start"].alias("b")))
    inner = s.select(*keys, F.explode(inside).alias("_p")).select(*keys, F.col("_p.a").alias("period_start_us"), F.col("_p.b").alias("period_end_us")).where("period_end_us IS NOT NULL")
    own = Window.partitionBy(*keys).orderBy("slice")
    after = own.rowsBetween(1, Window.unboundedFollowing)
    edges = s.select(*keys, "slice", F.try_element_at("gaps", F.lit(1))["gap_start"].alias("_close"), F.try_element_at("gaps", F.lit(-1))["gap_end"].alias("_open"), F.element_at("ends", -1).alias("_end"))
    edges = edges.withColumn("_next", F.first("_close", ignorenulls=True).over(after)).withColumn("_top", F.max("_end").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    across = edges.where("_open IS NOT NULL").select(*keys, F.col("_open").alias("period_start_us"), F.coalesce("_next", "_top").alias("period_end_us"))
    return inner.unionByName(across)
