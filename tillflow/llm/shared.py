"""Helpers of the operators: input tables, intermediate tables, Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillflow.scratch import settle

__all__ = ["add_python_columns", "packed", "read_table", "settle", "share_of", "text_bytes", "tidy_worker", "unpacked", "worker_cache"]

ROW = "_row"
ROWS_AT_ONCE = 1024  # rows of an Arrow batch that Python works on at a time; bounds its memory


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct beside working columns, so that no name of the row can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, names: Sequence[str], **columns: Column) -> DataFrame:
    """The row's own columns and then ``columns``, which replace equal names of the row."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"{ROW}.`{c}`").alias(c) for c in names if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def add_python_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., Sequence[pa.Array | list]]],
    cache: str | None = None,
) -> DataFrame:
    """Row-wise columns made in Python, one Arrow batch at a time; rows and their other columns pass through.

    ``start`` runs once per task and returns a function of the input columns of a batch that gives one list or Arrow
    array per field. Fields replace columns of the same name. ``cache`` names the :func:`worker_cache` in use.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    positions = [df.columns.index(c) for c in kept]
    reads = [df.columns.index(c) for c in inputs]
    schema = T.StructType([df.schema[i] for i in positions] + list(fields))
    types = [_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker(cache):
            work = start()
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    made = work(*[batch.column(i) for i in reads])
                    arrays = [m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(i) for i in positions] + arrays, names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "binary": pa.binary(), "float": pa.float32(),
    }
    if isinstance(dtype, T.ArrayType):
        return pa.list_(_arrow_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in dtype.fields])
    return simple[dtype.simpleString()]


def share_of(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``key`` only: which rows a sample of a stated share takes."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _caches() -> dict:
    return sys.modules.setdefault("_tillflow_worker", ModuleType("_tillflow_worker")).__dict__.setdefault("caches", {})


def worker_cache(name: str, make: Callable[[], object]):
    """An object that lives until this Python worker gets other work, for values that depend on their key only.

    Tasks of the same operator in the same worker then need not work out again what an earlier one has. The user bounds
    its size.
    """
    if name not in _caches():
        _caches()[name] = make()
    return _caches()[name]


@contextmanager
def tidy_worker(cache: str | None = None):
    """Around the work of a task: Spark keeps Python workers, and what one operator has cached or freed should not count
    as memory of the next."""
    for name in [n for n in _caches() if n != cache]:
        del _caches()[name]
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)
