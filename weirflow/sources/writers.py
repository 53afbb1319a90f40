"""Sinks besides Spark's own writers: small files written whole or not at all, and frames appended exactly once per batch."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame


def write_atomic(path: str, data: bytes) -> None:
    """A driver-side file that readers see either as it was or as it is to be."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def once_per_batch(folder: str, mode: str = "overwrite") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each micro-batch has a folder of its own, so a batch that is delivered again replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode(mode).parquet(os.path.join(folder, f"batch={batch_id}"))

    return write


def lines(df: DataFrame, folder: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(folder)
