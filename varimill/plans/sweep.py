"""Parallelism sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from varimill.operators.reports import with_throughput
from varimill.schemas import RUN_METRICS

_RUN = T.StructType(
    [f for f in RUN_METRICS.fields if f.name != "throughput_ticks_per_sec"]
    + [T.StructField("error", T.StringType())]
)


def sweep(
    spark: SparkSession,
    run: Callable[[int], int],
    input_partitions: Iterable[int],
    shuffle_partitions: Iterable[int],
    ml_enabled: bool = True,
) -> DataFrame:
    """Time ``run(input_partitions) -> ticks`` for every pair of settings.

    A run that fails is recorded with its error and the sweep goes on. One row
    per run, with its throughput; ``sinks.append_metrics`` stores them.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    shuffle_partitions = list(shuffle_partitions)
    rows = []
    try:
        for inputs in input_partitions:
            for shuffles in shuffle_partitions:
                spark.conf.set(setting, str(shuffles))
                stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
                start = time.monotonic()
                try:
                    ticks, error = run(inputs), None
                except Exception as e:  # noqa: BLE001 - reported, not hidden
                    ticks, error = 0, f"{type(e).__name__}: {e}"
                elapsed = int((time.monotonic() - start) * 1000)
                rows.append((stamp, shuffles, inputs, 0, ml_enabled, ticks, elapsed, error))
    finally:
        spark.conf.set(setting, before)
    runs = spark.createDataFrame(rows, _RUN)
    return with_throughput(runs).select(*RUN_METRICS.names, "error")
