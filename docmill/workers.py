"""Hands this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package once per application; Spark serves the file to every executor, late ones included."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "docmill-workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)


ROWS = 1000  # rows that a function gets at once


def _sparing(f: Callable) -> Callable:
    """Hands batches on in slices, so results stay small beside their input, and gives free memory
    back when the task ends: workers stay alive, and what they hold counts against their executor."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        def slices():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield batch.slice(at, ROWS)

        try:
            yield from f(slices())
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # no such call on this platform

    return run


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_sparing(f), schema)
