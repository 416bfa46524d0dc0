"""Helpers that the training-data operators share: shared storage and Arrow batching."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.sources.shared import shared_dir

#: Rows and bytes of an Arrow batch, whichever is reached first; a single row may be larger.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and ends the lineage."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with its folder, for ``delete`` once nothing reads the table any more. The shuffle
    files of the write go when it ends, as the table is read instead, not when the driver next
    happens to collect its garbage."""
    folder, conf = shared_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(f"{folder}/table")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table"), folder


def delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session still has Spark's defaults.

    Spark reads these settings when a plan runs, so they can't be limited to one plan; a
    session that sets either of its own keeps it.
    """
    for key, default, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` over dicts of column lists.

    ``make`` runs once in each task and returns the function that turns the columns of a
    batch into output columns, lists or Arrow arrays; output rows need not match input rows.
    """
    small_batches(df.sparkSession)
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _made(make)
        for batch in batches:
            got = step({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            columns = [got[f.name] for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


_kept: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps from task to task: the last thing that was asked for, only."""
    if key not in _kept:
        _kept.clear()
        _trim()
        _kept[key] = make()
    _kept["asked"] = True
    return _kept[key]


def _made(make: Callable):
    """``make()``; a task that asks for nothing kept frees what an earlier one left."""
    _kept.pop("asked", None)
    out = make()
    if not _kept.pop("asked", False) and _kept:
        _kept.clear()
        _trim()
    return out


def _trim() -> None:
    """Give the system back what is free: a worker goes on to other stages, beside other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[dict[str, list]], list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all its columns, for which the verdict on ``columns`` is true."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = _made(make)
        for batch in batches:
            yield batch.filter(pa.array(verdict({c: batch.column(c).to_pylist() for c in columns}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
