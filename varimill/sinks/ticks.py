"""Tick sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.functions import clock_text, day_name
from varimill.ledger import commit, current, next_run, read_run, write_parts
from varimill.schemas import DAILY_RV, DAY_ENTRY, TICK, TICK_AVRO
from varimill.sources.csv import line_place
from varimill.sources.kafka import TICK_TOPIC


def _with_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("day", day_name("ts"))


def _by_day(rows: DataFrame, rebalance: bool) -> DataFrame:
    """Gather the rows of a day, if asked, without piling a hot day on one task.

    Rebalancing by AQE splits large days and merges small ones by size.
    """
    return rows.hint("rebalance", "day") if rebalance else rows


def write_ticks(
    ticks: DataFrame, path: str, mode: str = "append", rebalance: bool = False
) -> None:
    """Parquet, one directory per day, for pruning by day.

    Each task writes one file per day it meets: right for input in rough time
    order, as daily files are. For input in no order, ``rebalance`` gathers the
    days first, at the price of a shuffle.
    """
    rows = _by_day(_with_day(ticks.select(*TICK.names)), rebalance)
    rows.write.mode(mode).partitionBy("day").parquet(path)


def write_file_ticks(ticks: DataFrame, table: str, run_id: int) -> None:
    """Ticks of daily files as parts of a run, one directory per file and day of the
    tick; they count once the run is in the table's ledger (``plans.ingest``)."""
    rows = _with_day(ticks.select(*TICK.names, "file_name"))
    write_parts(rows, table, run_id, "file_name", by=("day",))


def write_daily(
    daily: DataFrame,
    table: str,
    from_date: str | None = None,
    days: DataFrame | None = None,
    source_run: int | None = None,
) -> None:
    """Daily variance, one part per day.

    Settles all days from ``from_date`` on, or those in ``days`` (column ``day``): what
    the table held of them is replaced, also where no value is left.
    """
    spark = daily.sparkSession
    run_id = next_run(spark, table)
    # ``ts`` is the day's end, so the day is that of the instant before.
    rows = daily.withColumn("day", day_name("(ts - 1)"))
    write_parts(rows.repartition("day"), table, run_id, "day")
    written = T.StructType([*DAILY_RV.fields, T.StructField("day", T.StringType())])
    counts = read_run(spark, table, run_id, written).groupBy("day").agg(F.count("*").alias("rows"))
    if days is None:
        held = current(spark, table, DAY_ENTRY).select(F.col("key").alias("day"))
        days = held.where(F.col("day") >= (from_date or "")).unionByName(counts.select("day"))
    settled = days.select("day").distinct().join(counts, "day", "left")
    commit(
        settled.select(
            F.col("day").alias("key"),
            F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
            F.lit(source_run).cast("long").alias("source_run"),
        ),
        table,
        run_id,
    )


def land_ticks(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer from a stream of daily files to a tick table, ``seq`` complete.

    A batch has its own directory per day and replaces only that when repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("seq", F.col("seq") + line_place())
        rows = _with_day(numbered.select(*TICK.names))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")

    return write


def write_ticks_csv(
    ticks: DataFrame,
    path: str,
    mode: str = "error",
    rebalance: bool = False,
    day: str | None = None,
) -> None:
    """Daily tick files with a header line, one directory per day; with ``day`` all
    ticks go to the directory of this one, whatever their time."""
    dated = _with_day(ticks) if day is None else ticks.withColumn("day", F.lit(day))
    fields = dated.select(
        clock_text("ts").alias("DateTime"),
        F.col("bid").cast("string").alias("Bid"),
        F.col("ask").cast("string").alias("Ask"),
        F.col("volume").cast("string").alias("Volume"),
        F.col("spread").cast("string").alias("Spread"),
        F.col("symbol").alias("Symbol"),
        "day",
    )
    # Text as it is: a blank symbol stays blank.
    writer = _by_day(fields, rebalance).write.mode(mode).options(
        header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    # A day by itself leaves the others as they are.
    kept = "static" if day is None else "dynamic"
    writer.option("partitionOverwriteMode", kept).partitionBy("day").csv(path)


def tick_records(ticks: DataFrame, schema: str = TICK_AVRO, header: bytes = b"") -> DataFrame:
    """Kafka records: key is the symbol, value the Avro tick.

    ``header`` is put before the value, for registries that frame it.
    """
    from pyspark.sql.avro.functions import to_avro

    tick = F.struct(
        "symbol", F.col("ts").alias("timestamp"), "bid", "ask", "volume", "spread"
    )
    return ticks.select(
        F.col("symbol").cast("binary").alias("key"),
        F.concat(F.lit(bytearray(header)), to_avro(tick, schema)).alias("value"),
    )


def write_ticks_kafka(
    ticks: DataFrame, servers: str, topic: str = TICK_TOPIC, header: bytes = b""
) -> None:
    records = tick_records(ticks, header=header).write.format("kafka")
    records.option("kafka.bootstrap.servers", servers).option("topic", topic).save()
