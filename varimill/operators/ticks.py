"""Tick-level filters and audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


# The validity conditions by name; a tick is valid when all hold. Spark orders
# NaN above every number, so NaN has to be ruled out by name.
VALID = {
    "ts": "ts > 0",
    "bid": "NOT isnan(bid) AND bid > 0",
    "ask": "NOT isnan(ask) AND ask > 0",
    "crossed": "NOT isnan(bid) AND NOT isnan(ask) AND ask >= bid",
    "volume": "NOT isnan(volume) AND volume >= 0",
}


def valid_ticks(df: DataFrame) -> DataFrame:
    """Keep ticks with positive time, bid and ask, ask >= bid, volume >= 0.

    Given a positive bid, ask >= bid implies a positive ask, so the ask is read
    once: where it is computed, a filter would compute it per mention. Time, bid
    and volume stay plain comparisons, which reach the Parquet scan.
    """
    quote = "nanvl(ask, -1D) >= bid"
    return df.where(" AND ".join((VALID["ts"], VALID["bid"], VALID["volume"], quote)))


def invalid_reasons(df: DataFrame) -> DataFrame:
    """Ticks that fail, one row each, with the names of the failed conditions."""
    names = ", ".join(f"if(coalesce({ok}, false), NULL, '{n}')" for n, ok in VALID.items())
    return df.withColumn("reasons", F.expr(f"array_compact(array({names}))")).where(
        "size(reasons) > 0"
    )


def with_tick_counter(df: DataFrame, observation: Observation | str = "ticks") -> DataFrame:
    """Count rows as they pass; place before ``valid_ticks`` to count all ticks.

    Give an ``Observation`` for a batch frame, or a name for a stream, whose
    count then appears in the query progress under that name. This is a monitor:
    a stage that runs again after a lost executor counts again (``tick_counts``
    does not).
    """
    return df.observe(observation, F.count(F.lit(1)).alias("ticks"))


def tick_counts(df: DataFrame) -> DataFrame:
    """All ticks and the valid ones, as one row of a query."""
    valid = " AND ".join(f"({ok})" for ok in VALID.values())
    return df.agg(F.expr("count(*) AS ticks"), F.expr(f"count_if({valid}) AS valid"))


def ingest_counts(df: DataFrame, by: str = "file_name") -> DataFrame:
    """Ticks per ``by`` plus one grand-total row, whose ``by`` is null.

    The rollup runs over the per-group counts, so the ticks are aggregated once.
    """
    per_group = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return per_group.rollup(by).agg(F.sum("n").alias("ticks"))


def select_days(
    df: DataFrame, from_date: str | None = None, last_n: int = 0, col: str = "file_name"
) -> DataFrame:
    """Keep names from ``from_date`` on (inclusive), then the last N names.

    Names sort as dates do. ``last_n=0`` sets no limit. The N-th newest name
    becomes a scalar bound: no join, and only distinct names are ordered.
    """
    if from_date:
        df = df.where(F.col(col) >= from_date)
    if last_n > 0:
        newest = df.select(col).distinct().orderBy(F.desc(col)).limit(last_n)
        df = df.where(F.col(col) >= newest.orderBy(col).limit(1).scalar())
    return df
