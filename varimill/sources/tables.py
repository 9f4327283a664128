"""Ticks from tables, in batch or as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.ledger import current, has_ledger, read_parts
from varimill.schemas import DAILY_RV, FILE_ENTRY, TICK
from varimill.sources.csv import day_label


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(
    spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """The same table as a file stream."""
    schema = schema or read_table(spark, sf_dir, name).schema
    # As a pattern, the path may be one file or a directory of part files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def read_ticks(
    spark: SparkSession, path: str, streaming: bool = False, from_date: str | None = None
) -> DataFrame:
    """Ticks from a table with days as directories, as ``sinks`` writes them, or from
    the parts that count of an ingested one."""
    schema = T.StructType(TICK.fields + [T.StructField("day", T.StringType())])
    if has_ledger(spark, path):
        if streaming:
            raise ValueError("an ingested table is read in batch: its parts may be replaced")
        chosen = current(spark, path, FILE_ENTRY)
        if from_date:
            chosen = chosen.where(F.exists("days", lambda d: d["day"] >= from_date))
        df = read_parts(spark, path, schema, chosen)
    else:
        df = (spark.readStream if streaming else spark.read).schema(schema).parquet(path)
        df = df.select(*schema.names)
    return df.where(F.col("day") >= from_date) if from_date else df


def day_bound(spark: SparkSession, path: str, from_date: str | None = None, last_n: int = 0) -> str | None:
    """The first of the last ``last_n`` days of a tick table from ``from_date`` on; all
    of them without ``last_n``. Days are known from the ledger or the listing."""
    if last_n <= 0:
        return from_date
    if has_ledger(spark, path):
        days = current(spark, path, FILE_ENTRY).select(F.explode("days.day").alias("day")).distinct()
        newest = days.where(F.col("day") >= (from_date or "")).orderBy(F.desc("day")).limit(last_n)
        names = sorted(r["day"] for r in newest.collect())
    else:
        names = sorted({day_label(f) for f in spark.read.parquet(path).inputFiles()})
        names = [n for n in names if n >= (from_date or "")][-last_n:]
    return names[0] if names else from_date


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily variance from the table ``sinks.write_daily`` writes, with its ``day``."""
    schema = T.StructType(DAILY_RV.fields + [T.StructField("day", T.StringType())])
    return read_parts(spark, path, schema)


def ticks_from_events(
    events: DataFrame, symbol: str = "event_type", from_date: str | None = None
) -> DataFrame:
    """Read an event log as ticks; ``symbol`` is a SQL expression.

    The value is the bid; ``k`` of the properties moves the ask by -5 to 94
    cents, so some quotes are crossed; user ids divisible by 50 give a negative
    volume. The event id breaks ties on time. Times are taken as UTC.
    ``from_date`` bounds the event time itself, which reaches the scan.
    """
    if from_date:
        events = events.where(F.col("ts") >= F.lit(from_date).cast(events.schema["ts"].dataType))
    # The properties hold this one number; a pattern costs a tenth of a JSON parse.
    k = """try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS int)"""
    return events.selectExpr(
        f"{symbol} AS symbol",
        "unix_millis(cast(ts AS timestamp)) AS ts",
        "value AS bid",
        f"value + cast({k} - 5 AS double) / 100D AS ask",
        "cast(user_id % 50 AS double) - 1 AS volume",
        "event_id AS seq",
    ).selectExpr("symbol", "ts", "bid", "ask", "volume", "ask - bid AS spread", "seq")
