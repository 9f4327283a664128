"""Questions asked of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimill.functions import throughput


def predictions_by_symbol(predictions: DataFrame) -> DataFrame:
    """Number of predictions per symbol, most first."""
    counts = predictions.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "symbol")


def predictions_with_model(predictions: DataFrame, *cols: str) -> DataFrame:
    """How many predictions carry an output of each model, in one pass."""
    return predictions.agg(*(F.count(c).alias(c) for c in cols or ("mamba_pred",)))


def head_ordered(df: DataFrame, n: int = 10, by: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    """First ``n`` rows of a total order, so that every run shows the same."""
    return df.orderBy(*by).limit(n)


def with_throughput(
    df: DataFrame, ticks: str = "total_ticks", elapsed_ms: str = "elapsed_ms"
) -> DataFrame:
    """Add ticks per second; a run that took no time has throughput 0."""
    return df.withColumn("throughput_ticks_per_sec", throughput(ticks, elapsed_ms))
