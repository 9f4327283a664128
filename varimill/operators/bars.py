"""Ticks to log-return bars to daily realized variance, in batch or streaming."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimill.config import PipelineConfig
from varimill.functions import arrival_key, event_time, millis

_DEFAULT = PipelineConfig()


def _span(width: timedelta) -> str:
    return f"{millis(width)} milliseconds"


def with_event_time(df: DataFrame, delay: timedelta | None = _DEFAULT.watermark) -> DataFrame:
    """Add ``event_time``; on a stream also the watermark (None: no watermark)."""
    df = df.withColumn("event_time", event_time("ts"))
    if df.isStreaming and delay is not None:
        df = df.withWatermark("event_time", _span(delay))
    return df


def log_return_bars(
    ticks: DataFrame,
    width: timedelta = _DEFAULT.bar_width,
    min_ticks: int = _DEFAULT.min_ticks,
    key: str = "symbol",
) -> DataFrame:
    """``ln(last bid / first bid)`` per key and tumbling window.

    First and last go by ``(ts, seq)``: on equal times the earliest arrival
    opens the bar and the latest closes it. ``ts`` of a bar is its end. Bars of
    fewer than ``min_ticks`` ticks are dropped. State per bar is constant, and
    the partial aggregate shrinks ticks to bars before the shuffle, so a hot
    key moves no more rows than it has bars per input split.
    """
    seq = "seq" if "seq" in ticks.columns else None
    order_key = arrival_key("ts", seq, width).alias("order_key")
    span = f"{millis(width)}L"
    if ticks.isStreaming:
        if "event_time" not in ticks.columns:
            ticks = with_event_time(ticks)
        rows = ticks.select(key, "event_time", "bid", order_key)
        bar, end = F.window("event_time", _span(width)).alias("bar"), "unix_millis(bar.end)"
        kept = ["bar"]
    else:
        # The same windows; without a watermark to serve, a long is the leaner key.
        bar_end = F.expr(f"ts - pmod(ts, {span}) + {span}").alias("bar_end")
        rows = ticks.select(key, bar_end, "bid", order_key)
        bar, end, kept = "bar_end", "bar_end", []
    return (
        rows.groupBy(key, bar)
        .agg(
            F.expr("min_by(bid, order_key) AS first_bid"),
            F.expr("max_by(bid, order_key) AS last_bid"),
            F.expr("count(*) AS n_ticks"),
        )
        .where(f"n_ticks >= {min_ticks}")
        .selectExpr(
            key, *kept, f"{end} AS ts", "ln(last_bid / first_bid) AS log_return", "n_ticks"
        )
    )


def partial_bars(
    ticks: DataFrame,
    width: timedelta = _DEFAULT.bar_width,
    key: str = "symbol",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Bars that can still be merged: first and last bid with their places in the bar,
    and the number of ticks, per key, bar and ``by``."""
    seq = "seq" if "seq" in ticks.columns else None
    span = f"{millis(width)}L"
    bar_end = F.expr(f"ts - pmod(ts, {span}) + {span}").alias("bar_end")
    rows = ticks.select(key, *by, bar_end, "bid", arrival_key("ts", seq, width).alias("order_key"))
    return rows.groupBy(key, "bar_end", *by).agg(
        F.expr("min(order_key) AS first_key"),
        F.expr("min_by(bid, order_key) AS first_bid"),
        F.expr("max(order_key) AS last_key"),
        F.expr("max_by(bid, order_key) AS last_bid"),
        F.expr("count(*) AS n_ticks"),
    )


def merged_partials(partials: DataFrame, key: str = "symbol") -> DataFrame:
    """Partial bars of the same key and bar as one."""
    return partials.groupBy(key, "bar_end").agg(
        F.expr("min(first_key) AS first_key"),
        F.expr("min_by(first_bid, first_key) AS first_bid"),
        F.expr("max(last_key) AS last_key"),
        F.expr("max_by(last_bid, last_key) AS last_bid"),
        F.expr("sum(n_ticks) AS n_ticks"),
    )


def merged_bars(
    partials: DataFrame, min_ticks: int = _DEFAULT.min_ticks, key: str = "symbol"
) -> DataFrame:
    """The bars of ``log_return_bars`` from partial ones, whatever ticks were dealt to
    which of them."""
    return (
        partials.groupBy(key, "bar_end")
        .agg(
            F.expr("min_by(first_bid, first_key) AS first_bid"),
            F.expr("max_by(last_bid, last_key) AS last_bid"),
            F.expr("sum(n_ticks) AS n_ticks"),
        )
        .where(f"n_ticks >= {min_ticks}")
        .selectExpr(key, "bar_end AS ts", "ln(last_bid / first_bid) AS log_return", "n_ticks")
    )


def daily_rv(
    bars: DataFrame, period: timedelta = _DEFAULT.period, key: str = "symbol"
) -> DataFrame:
    """Sum of squared bar returns per key and day; ``ts`` is the day's end.

    A bar belongs to the day of its last instant, so the 23:55 bar stays in its
    day although its ``ts`` is the next midnight.
    """
    squares = F.expr("sum(log_return * log_return) AS rv_daily")
    if bars.isStreaming:
        window = F.window(F.window_time("bar"), _span(period)).alias("day")
        return bars.groupBy(key, window).agg(squares).selectExpr(
            key, "unix_millis(day.end) AS ts", "rv_daily"
        )
    span = f"{millis(period)}L"
    day_end = F.expr(f"ts - 1 - pmod(ts - 1, {span}) + {span} AS day_end")
    days = bars.select(key, day_end, "log_return").groupBy(key, "day_end").agg(squares)
    return days.selectExpr(key, "day_end AS ts", "rv_daily")
