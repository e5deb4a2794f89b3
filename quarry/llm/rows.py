"""Python functions over texts: a column with the rest of each row beside it, and batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows and bytes of an Arrow batch; the JVM and a worker each hold a few.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside send rows to Python in small batches."""
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a batch whose texts and words a worker holds as Python objects.
ROWS_AT_ONCE = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows. After the last one, freed memory goes
    back to the system, since a worker outlives its tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def trim() -> None:
    """Give freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if trimmed := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trimmed(0)


def with_columns(
    docs: DataFrame,
    text: Column,
    make: Callable[[], Callable[[list], dict[str, list]]],
    schema: str,
    keep: tuple[str, ...] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """``docs`` as a struct column ``row`` (its columns ``keep``, or all of
    them, whatever their names) and the columns of ``schema``, which ``make()``
    computes from lists of ``text``, of ``rows_at_once`` texts at most. ``make``
    runs once in each task."""
    kind = T._parse_datatype_string(schema)
    row = F.struct("*") if keep is None else F.struct(*(F.col(f"`{c}`") for c in keep))
    rows = docs.select(row.alias("row"), text.alias("__text"))
    whole = T.StructType([rows.schema["row"], *kind.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kind.fields]
        f = make()
        for batch in slices(batches, rows_at_once):
            found = f(batch.column(1).to_pylist())
            arrays = [pa.array(found[x.name], t) for x, t in zip(kind.fields, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *kind.names])

    return rows.mapInArrow(run, whole)
