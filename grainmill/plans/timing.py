"""Opt-in stage timers, whose records are a table like any other."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.analysis import stage_stats

_records: list[tuple[str, float]] = []


def enabled() -> bool:
    return os.environ.get("GRAINMILL_TIMING", "") not in ("", "0")


@contextmanager
def stage(name: str) -> Iterator[None]:
    """Records the wall-clock seconds of the block if timing is enabled."""
    begin = time.perf_counter()
    try:
        yield
    finally:
        if enabled():
            record(name, time.perf_counter() - begin)


def record(name: str, seconds: float) -> None:
    _records.append((name, float(seconds)))


def timings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_records, "stage string, seconds double")


def timing_report(spark: SparkSession) -> DataFrame:
    """Milliseconds by stage."""
    return stage_stats(timings(spark).selectExpr("stage", "seconds * 1000 AS ms"), "ms", "stage")
