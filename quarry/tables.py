"""Tables in a folder that every executor and the driver can reach.

Operators leave their tables there, as a DataFrame that they return may still
read them. A job that has saved its result deletes what its operators left by
calling them inside ``scope``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the innermost ``scope`` of this thread.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local
    session gets a temporary one and any other session is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith(
            "local-cluster"
        ):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return base


def _unused(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """What is written inside goes to a folder of its own, which is deleted at
    the end, also after an error. Results must be saved elsewhere by then (at a
    path named outside, or by the caller). Scopes may be nested, and those of
    other threads are left alone."""
    path = _unused(_scope.get() or shared_dir(spark), "scope")
    token = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(token)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or that of the scope, that nothing has used yet."""
    return _unused(_scope.get() or shared_dir(spark), name)


def stage(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage ends there and a lost executor costs no recomputation. options: of
    the Parquet writer."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
