"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, scratch, shared_dir, stored

__all__ = ["KEPT", "crc32_of", "discard", "let_go", "one_thread", "own_name", "scratch", "shared_dir", "small_batches", "stored", "table", "tidied", "tidy_shuffles"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def crc32_of(col):
    """Unsigned CRC-32 of a column's text form."""
    return F.crc32(col.cast("string").cast("binary"))


def tidy() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are done with: it does so when the driver collects its garbage, on its own every half hour."""
    gc.collect()
    spark._jvm.System.gc()


#: Clears what a Python worker keeps from task to task for one kind of work.
KEPT: list = []


def let_go() -> None:
    """At the begin of other work in a worker: what it keeps for earlier work goes."""
    for clear in KEPT:
        clear()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Frames that run inside send Python so many rows at a time: the texts of ten thousand take much memory outside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(int(held), rows) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


@functools.cache
def blas():
    """Functions that get and set the number of threads of numpy's own BLAS; None if it is another one."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for pattern in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            with contextlib.suppress(AttributeError):
                return getattr(lib, pattern.format("get")), getattr(lib, pattern.format("set"))
    return None


@contextlib.contextmanager
def one_thread():
    """Small matrices on one thread: a task has one core, and threads that wait for each other spin."""
    held = blas()[0]() if blas() else 0
    if held:
        blas()[1](1)
    try:
        yield
    finally:
        if held:
            blas()[1](held)


def tidied(f):
    """For functions of mapInArrow: numpy keeps to one thread, and when a task ends its worker waits for the next one without the task's free memory."""

    @functools.wraps(f)
    def run(batches):
        try:
            with one_thread():
                yield from f(batches)
        finally:
            tidy()

    return run
