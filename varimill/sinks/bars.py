"""Stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame

BAR_COLUMNS = ("symbol", "ts", "log_return", "n_ticks")


def write_bars_bucketed(
    bars: DataFrame, table: str, buckets: int, mode: str = "overwrite", path: str | None = None
) -> None:
    """A table of bars bucketed by symbol.

    Daily variance and all features read from it without a shuffle
    (``operators.daily_rv``). A symbol has at most one bar per five minutes,
    however many ticks, so no bucket grows with the tick volume of a hot symbol.
    """
    rows = bars.select(*BAR_COLUMNS).repartition(buckets, "symbol")
    writer = rows.write.mode(mode).format("parquet").bucketBy(buckets, "symbol")
    (writer.option("path", path) if path else writer).saveAsTable(table)
