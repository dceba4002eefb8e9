"""How often every distinct term occurs, in how many records, and which are too rare or too common.

Tokens are partitioned by a hash of the term and of a bucket of the record, and ordered by term and
record.  One pass with last-seen counters follows: for the current term it keeps occurrences, records
and the last record's identifier; a record counts when it differs from the last one.  No set of
records is ever kept.  A record falls into one bucket, so the counts of a term's buckets add up
exactly, and a term that holds a third of all tokens is spread over all tasks.

Before the shuffle every scan task runs the same counters over its own rows, sorted in runs, so that
what is shuffled has one row for a term and record of a task, not for an occurrence.

Defined results: terms are compared code point by code point, as they stand; null terms aren't
counted; a record with null parts of its key is a record of its own; records with no term at all
still count as records.  If a term is both rare and common it is rare.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, combined, map_arrow

#: Buckets of records that a term is spread over.
BUCKETS = 64
#: Rows that a task counts at a time before the shuffle.
ROWS_AT_ONCE = 262_144
#: The field whose only term is "" and whose records are all records.
ALL = ""


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before it in any column."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        i = np.asarray(pc.fill_null(c.dictionary_encode().indices, -1))
        new[1:] |= i[1:] != i[:-1]
    return new


def _before_shuffle(fields: list[str], n_record: int):
    """(field, term, record) with its occurrences among some rows of this task."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            record = [combined(t.column(i)) for i in range(n_record)]
            codes = [np.asarray(pc.fill_null(c.dictionary_encode().indices, -1)) for c in record]
            for k, name in enumerate((ALL, *fields)):
                if name == ALL:
                    term = np.zeros(t.num_rows, np.int64)
                    names = pa.array([""])
                else:
                    d = combined(t.column(n_record + k - 1)).dictionary_encode()
                    term, names = np.asarray(pc.fill_null(d.indices, -1)), d.dictionary
                order = np.lexsort((*reversed(codes), term))
                order = order[term[order] >= 0]
                if not len(order):
                    continue
                new = np.zeros(len(order), bool)
                new[0] = True
                for c in (term, *codes):
                    s = c[order]
                    new[1:] |= s[1:] != s[:-1]
                at = np.flatnonzero(new)
                rows = pa.array(order[at])
                yield batch(
                    [pa.array([name] * len(at)), names.take(pa.array(term[order[at]])), *(c.take(rows) for c in record), np.diff(np.append(at, len(order)))], schema
                )

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from counted(held)
                held, rows = [], 0
        if held:
            yield from counted(held)

    return run


def _last_seen(n_record: int):
    """Occurrences and records of each term, from rows in the order of field, term and record."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # field and term, record, occurrences, records
        for b in batches:
            if not b.num_rows:
                continue
            columns = [combined(b.column(i)) for i in range(2 + n_record)]
            occ = np.asarray(b.column(2 + n_record))
            new_term, new_record = _changes(columns[:2]), _changes(columns)
            heads = np.flatnonzero(new_term)
            occurrences, records = np.add.reduceat(occ, heads), np.add.reduceat(new_record.astype(np.int64), heads)
            rows = pa.array(heads)
            names = list(zip(columns[0].take(rows).to_pylist(), columns[1].take(rows).to_pylist()))
            first, final = (tuple(c[i].as_py() for c in columns[2:]) for i in (0, b.num_rows - 1))
            occurrences, records = occurrences.tolist(), records.tolist()
            if last is not None:
                if last[0] == names[0]:
                    occurrences[0] += last[2]
                    records[0] += last[3] - (last[1] == first)
                else:
                    names.insert(0, last[0])
                    occurrences.insert(0, last[2])
                    records.insert(0, last[3])
            last = (names[-1], final, occurrences[-1], records[-1])
            if len(names) > 1:
                yield batch([[f for f, _ in names[:-1]], [t for _, t in names[:-1]], occurrences[:-1], records[:-1]], schema)
        if last is not None:
            yield batch([[last[0][0]], [last[0][1]], [last[2]], [last[3]]], schema)

    return run


def term_counts(df: DataFrame, fields: list[str], record: list[str], buckets: int = BUCKETS) -> DataFrame:
    """field, term, occurrences, records; and one row of the field ``ALL`` whose records are all records."""
    n = len(record)
    kept = ", ".join(f"_r{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(record))
    names = [f"_r{i}" for i in range(n)]
    rows = df.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(record)), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)))
    tokens = map_arrow(rows, _before_shuffle(fields, n), f"field STRING, term STRING, {kept}, occ BIGINT")
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets))
    ordered = tokens.repartition(F.col("field"), F.col("term"), bucket).sortWithinPartitions("field", "term", *names)
    parts = map_arrow(ordered, _last_seen(n), "field STRING, term STRING, occurrences BIGINT, records BIGINT")
    return parts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(counts: DataFrame, fields: list[str], rare_at_most: int = 3, common_over: float = 0.5) -> DataFrame:
    """field, term, occurrences, records, all_records, mark ('rare', 'common' or null) of each term.

    The number of all records is one row for each field, joined by field.
    """
    total = counts.where(F.col("field") == ALL).select(F.explode(F.array(*map(F.lit, fields))).alias("field"), F.col("records").alias("all_records"))
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > F.col("all_records") * common_over, "common")
    return counts.where(F.col("field") != ALL).join(F.broadcast(total), "field").withColumn("mark", mark)
