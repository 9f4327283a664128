"""Complete stream runs: process, flush, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from varimill.config import PipelineConfig
from varimill.schemas import DAILY_RV, REQUEST
from varimill.streaming import (
    available_now,
    daily_rv_stream,
    latest_event_ms,
    request_stream,
    send_flush,
    with_flush,
    write_batches,
)
from varimill.workspace import run_dir

_DEFAULT = PipelineConfig()


def daily_stream(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    return daily_rv_stream(ticks, config.watermark, config.bar_width, config.min_ticks, config.period)


def requests_stream(
    ticks: DataFrame, config: PipelineConfig = _DEFAULT, history: DataFrame | None = None
) -> DataFrame:
    """Requests of a tick stream; ``history`` holds the days of before it."""
    daily = daily_stream(ticks, config)
    return request_stream(
        daily, config.test_start, config.weekly, config.monthly, config.payload_decimals, history
    )


def stream_to_table(
    ticks: DataFrame, build, schema: T.StructType, config: PipelineConfig = _DEFAULT
) -> DataFrame:
    """Run ``build(ticks)`` over what the tick stream holds, closing all windows.

    Two runs on one checkpoint: the first takes the ticks, the second a flush
    tick dated after them.
    """
    spark = ticks.sparkSession
    base = run_dir(spark, "stream")
    flush, out, checkpoint = (f"{base}/{d}" for d in ("flush", "out", "checkpoint"))
    parallelism = spark.sparkContext.defaultParallelism
    result = build(with_flush(ticks, flush))
    first = available_now(result, write_batches(out), checkpoint, parallelism)
    send_flush(spark, flush, latest_event_ms(first, config.watermark), config.watermark, config.period)
    available_now(result, write_batches(out), checkpoint, parallelism)
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def stream_daily_rv(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    return stream_to_table(ticks, lambda t: daily_stream(t, config), DAILY_RV, config)


def stream_to_requests(
    ticks: DataFrame, config: PipelineConfig = _DEFAULT, history: DataFrame | None = None
) -> DataFrame:
    return stream_to_table(ticks, lambda t: requests_stream(t, config, history), REQUEST, config)
