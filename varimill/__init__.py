"""varimill: realized variance and next-day volatility forecasts on Spark.

Ticks become five-minute log-return bars, bars become daily realized variance,
days become daily/weekly/monthly features, features become forecasts. Every
step is a function from DataFrame to DataFrame; the tick-level ones accept
batch and streaming frames alike.
"""

from varimill.config import PipelineConfig

__all__ = ["PipelineConfig"]
