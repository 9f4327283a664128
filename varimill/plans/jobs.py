"""Whole runs, from stored input to stored output."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from varimill.config import PipelineConfig
from varimill.functions import utc_midnight_ms
from varimill.ledger import commit, entries, entries_of, next_run
from varimill.operators.scoring import Scorer
from varimill.plans.batch import (
    daily_requests,
    daily_variance,
    score_requests,
    scored_requests,
    unscored,
    unscored_requests,
)
from varimill.plans.streams import requests_stream
from varimill.schemas import RUN_METRICS
from varimill.sinks import append_metrics, write_daily, write_scored
from varimill.sources import day_bound, read_daily, read_ticks
from varimill.streaming import (
    available_now,
    dead_letter_stream,
    latest_event_ms,
    replay_batches,
    score_batches,
    send_flush,
    with_flush,
)


def forecast_job(
    spark: SparkSession,
    table: str,
    root: str,
    run_id: int = 0,
    scorer: Scorer | None = None,
    config: PipelineConfig | None = None,
    metrics: str | None = None,
    **options,
) -> None:
    """Tick table to predictions and dead letters below ``root``.

    The same ``run_id`` replaces its earlier outcome. ``metrics`` is where the
    run's size and throughput are appended.
    """
    config = config or PipelineConfig.from_session(spark)
    from_date = day_bound(spark, table, config.from_date, config.last_n)
    ticks = read_ticks(spark, table, from_date=from_date)
    start = time.monotonic()
    if config.ml_enabled:
        scored = scored_requests(ticks, scorer, config, **options)
    else:
        scored = unscored_requests(ticks, config)
    write_scored(scored, run_id, root, config.sink_partitions)
    elapsed = time.monotonic() - start
    if metrics is not None:
        # Counted by itself, from the files' own counts: an observer of the run would
        # count a repeated task twice and sees nothing of a plan that ends up empty.
        _append_run(spark, metrics, len(ticks.inputFiles()), config, ticks.count(), elapsed)


def daily_job(
    spark: SparkSession,
    table: str,
    daily_table: str,
    from_date: str | None = None,
    config: PipelineConfig | None = None,
) -> None:
    """Tick table to the daily variance table, from a day on.

    Only the tick directories of these days are read, and only these days of the
    daily table are replaced.
    """
    config = config or PipelineConfig.from_session(spark)
    ticks = read_ticks(spark, table, from_date=from_date or config.from_date)
    write_daily(daily_variance(ticks, config), daily_table, from_date or config.from_date)


def daily_forecast_job(
    spark: SparkSession,
    daily_table: str,
    root: str,
    run_id: int | str,
    scorer: Scorer | None = None,
    from_date: str | None = None,
    config: PipelineConfig | None = None,
    **options,
) -> None:
    """Predictions and dead letters for the days from ``from_date`` on.

    Histories come from the daily table, which has a row per symbol and day; no
    tick is read.
    """
    config = config or PipelineConfig.from_session(spark)
    rows = daily_requests(read_daily(spark, daily_table).drop("day"), config)
    if from_date:
        rows = rows.where(F.col("ts") > utc_midnight_ms(from_date))
    if config.ml_enabled:
        scored = score_requests(rows, scorer, config, **options)
    else:
        scored = unscored(rows)
    write_scored(scored, run_id, root, config.sink_partitions)


def _append_run(
    spark: SparkSession, path: str, inputs: int, config: PipelineConfig, ticks: int, elapsed: float
) -> None:
    row = (
        datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"),
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        inputs,
        0,
        config.ml_enabled,
        ticks,
        int(elapsed * 1000),
    )
    append_metrics(spark.createDataFrame([row], RUN_METRICS.names[:-1]), path)


def stream_forecast_job(
    spark: SparkSession,
    ticks: DataFrame,
    root: str,
    base: str,
    scorer: Scorer | None = None,
    config: PipelineConfig | None = None,
    flush: bool = False,
    metrics: str | None = None,
    state_partitions: int | None = None,
    history: DataFrame | None = None,
    **options,
) -> StreamingQuery:
    """A stream of ticks to predictions and dead letters below ``root``.

    Takes what there is and stops; called again with the same ``base``, which holds
    the checkpoint, it goes on. ``flush`` closes the last day as well; days after it
    may still come. Predictions and letters of a micro-batch are one write that
    replaces itself when repeated. ``history`` holds daily variance of before the
    stream, with which a new one starts.
    """
    config = config or PipelineConfig.from_session(spark)
    flushes, checkpoint = f"{base}/flush", f"{base}/checkpoint"
    requests = requests_stream(with_flush(ticks, flushes), config, history)
    if config.ml_enabled:
        options = {
            "b": config.har,
            "decimals": config.payload_decimals,
            "max_attempts": config.max_attempts,
            "backoff_ms": config.backoff_ms,
            "breaker_threshold": config.breaker_threshold,
            "breaker_open_s": config.breaker_open_s,
            "capacity": config.capacity,
            "in_flight": config.in_flight,
            "call_timeout_s": config.call_timeout_s,
            "total_timeout_s": config.total_timeout_s,
            "partitions": config.scoring_partitions,
        } | options
        write = score_batches(root, scorer, config.sink_partitions, **options)
    else:
        write = _unscored_batches(root, config)
    parallelism = state_partitions or spark.sparkContext.defaultParallelism
    start = time.monotonic()
    query = available_now(requests, write, checkpoint, parallelism)
    if flush:
        latest = latest_event_ms(query, config.watermark)
        send_flush(spark, flushes, latest, config.watermark, config.period)
        query = available_now(requests, write, checkpoint, parallelism)
    elapsed = time.monotonic() - start
    if metrics is not None:
        seen = _count_ticks(spark, ticks, f"{base}/counts")
        _append_run(spark, metrics, parallelism, config, seen, elapsed)
    return query


def _unscored_batches(root: str, config: PipelineConfig) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        write_scored(unscored(batch), batch_id, root, config.sink_partitions)

    return write


def _count_ticks(spark: SparkSession, ticks: DataFrame, root: str) -> int:
    """Ticks that have come since this was last called, by a stream of its own over the
    same source: a count per micro-batch in a ledger, so a repeated batch counts once.
    """
    before = next_run(spark, f"{root}/table")

    def write(batch: DataFrame, batch_id: int) -> None:
        # No column is read.
        n = batch.count()
        if entries_of(spark, f"{root}/table", batch_id + 1, _NO_COLUMNS) is None:
            row = spark.createDataFrame([(str(batch_id), n)], "key string, rows long")
            commit(row, f"{root}/table", batch_id + 1)

    available_now(ticks.select("symbol"), write, f"{root}/checkpoint")
    counts = entries(spark, f"{root}/table", _NO_COLUMNS).where(F.col("run_id") >= before)
    return counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


_NO_COLUMNS = T.StructType([])


def replay_job(
    spark: SparkSession,
    root: str,
    replayed_root: str | None,
    checkpoint: str,
    scorer: Scorer | None = None,
    **options,
) -> None:
    """Replay the dead letters below ``root`` that no earlier replay has taken.

    Outcomes go to ``replayed_root``, by default to the same store, where
    predictions of replays stand beside those of forecasts.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    letters = dead_letter_stream(spark, root)
    write = replay_batches(replayed_root or root, run, scorer, **options)
    available_now(letters, write, checkpoint)
