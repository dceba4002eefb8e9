"""Helpers around mapInArrow: whole record batches in, whole record batches out."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for a session, so that it needs no installation there."""
    context = spark.sparkContext
    if getattr(context, "_spandrel_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # else it came to this process in the same way
        folder = tempfile.mkdtemp(prefix="spandrel-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "spandrel.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, files in sorted(os.walk(root)):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(at, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    context._spandrel_shipped = True


def schema_of(ddl: str) -> T.StructType:
    """A StructType from a DDL string, without a session."""
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from Python lists, numpy or Arrow arrays in the schema's order."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """df.mapInArrow(fn) where fn also gets the Arrow schema it has to return."""
    ship(df.sparkSession)
    spark_schema = schema_of(ddl)
    out = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batches, out)

    return df.mapInArrow(run, spark_schema)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, where a row may be large and becomes Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def combined(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
