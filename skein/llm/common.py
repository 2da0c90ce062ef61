"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def empty_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


#: Bytes that an Arrow batch for a Python worker holds, or a little more.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about BATCH_BYTES, whole texts being of any length.

    A session that has a setting of its own keeps it.
    """
    if spark.conf.get(_BATCH, "1b") == "1b":  # not set
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which gives memory back at its end."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session.  Only where none is set and all runs in one process,
    as in tests, a folder below the warehouse is used; a cluster without the setting raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> str:
    """Write ``df`` to a fresh shared folder and tell its path."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it again."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def map_batches(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` onto the same columns, whatever their names are (dots included)."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(tidied(run), plain.schema).toDF(*df.columns)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame | None) -> None:
    """Delete the files behind a result of :func:`materialise`."""
    if df is not None:
        delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})
