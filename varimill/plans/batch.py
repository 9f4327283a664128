"""The pipeline from ticks to predictions as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from varimill.config import PipelineConfig
from varimill.operators import (
    bypass,
    daily_rv,
    log_return_bars,
    model_requests,
    score,
    split_scored,
    valid_ticks,
)
from varimill.operators.scoring import Scorer

_DEFAULT = PipelineConfig()


def daily_variance(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    bars = log_return_bars(valid_ticks(ticks), config.bar_width, config.min_ticks)
    return daily_rv(bars, config.period)


def requests(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    return daily_requests(daily_variance(ticks, config), config)


def daily_requests(daily: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    return model_requests(
        daily,
        config.test_start,
        weekly=config.weekly,
        monthly=config.monthly,
        decimals=config.payload_decimals,
    )


def scored_requests(
    ticks: DataFrame, scorer: Scorer | None = None, config: PipelineConfig = _DEFAULT, **options
) -> DataFrame:
    """Requests with outcome; see ``operators.score`` for the options."""
    return score_requests(requests(ticks, config), scorer, config, **options)


def score_requests(
    rows: DataFrame, scorer: Scorer | None = None, config: PipelineConfig = _DEFAULT, **options
) -> DataFrame:
    return score(
        rows,
        scorer,
        b=config.har,
        decimals=config.payload_decimals,
        **{
            "max_attempts": config.max_attempts,
            "backoff_ms": config.backoff_ms,
            "breaker_threshold": config.breaker_threshold,
            "breaker_open_s": config.breaker_open_s,
            "capacity": config.capacity,
            "in_flight": config.in_flight,
            "call_timeout_s": config.call_timeout_s,
            "total_timeout_s": config.total_timeout_s,
            "partitions": config.scoring_partitions,
        }
        | options,
    )


def unscored_requests(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    """Requests with the outcome they have when models are switched off."""
    return unscored(requests(ticks, config))


def unscored(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*",
        "'ok' AS status",
        "0D AS har_pred",
        "0 AS attempts",
        "cast(NULL AS double) AS mamba_pred",
        "cast(NULL AS double) AS lstm_pred",
        "cast(NULL AS string) AS error",
    )


def forecasts(ticks: DataFrame, config: PipelineConfig = _DEFAULT) -> DataFrame:
    """Predictions without a sequence model: linear forecast, or bypass.

    Nothing in this plan leaves the JVM.
    """
    if not config.ml_enabled:
        return bypass(requests(ticks, config))
    predictions, _ = split_scored(scored_requests(ticks, None, config))
    return predictions
