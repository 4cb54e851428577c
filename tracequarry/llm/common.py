"""Helpers that the operators of this subpackage share: tables, saved intermediates, free names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.store import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it again.

    This computes it once, cuts its lineage, and leaves nothing that is lost with an executor.
    """
    return kept(frame, name)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which freed memory goes back to the system.

    Python processes outlive their tasks, and what one stage's have freed but hold would be missing for the next.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside exchanges batches of so many rows with Python at most, which bounds both sides' buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of the taken ones equals in either case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name
