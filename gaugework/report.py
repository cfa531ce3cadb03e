"""Sizes, ratios and rates."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

GIB = 1 << 30


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or directory in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def ratios(raw: int, stored: int, index: int = 0) -> dict[str, float]:
    """ratio_percent: stored by raw; saved_percent: what stored and index leave free. 0 for no raw bytes."""
    if not raw:
        return {"ratio_percent": 0.0, "saved_percent": 0.0}
    return {"ratio_percent": 100 * stored / raw, "saved_percent": 100 * (raw - stored - index) / raw}


def rates(rows: int, n_bytes: int, seconds: float) -> dict[str, float]:
    seconds = max(seconds, 1e-4)
    return {"seconds": seconds, "million_rows_per_second": rows / seconds / 1e6, "gib_per_second": n_bytes / GIB / seconds}


def timed(action: Callable[[], DataFrame]) -> tuple[list, float]:
    """The rows of a small result, and the seconds until they were there."""
    began = time.perf_counter()
    rows = action().collect()
    return rows, time.perf_counter() - began
