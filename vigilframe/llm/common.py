"""Shared helpers of the training-data operators: tables, shared storage, batches of text."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a
    folder of the machine, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or "file:/tmp/vigilframe-checkpoints"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back.

    This cuts the lineage and computes a reused intermediate once; the files outlive a lost executor.
    They stand below ``<shared>/<application id>`` until ``clean_up`` or the cluster's own sweep removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes what ``materialize`` wrote in this application. Call it when no result of these operators is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_held: list[tuple[Hashable, Any]] = []


def _release() -> None:
    """Gives memory that is no longer used back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: the tables of the operator that it ran last, and no other's, so that
    the stages of a pipeline don't add up in one worker."""
    if not _held or _held[0][0] != key:
        if _held:
            _held.clear()
            _release()
        _held.append((key, make()))
    return _held[0][1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``max_bytes`` of text in each (one row at least)."""
    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
