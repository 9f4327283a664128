"""Daily files to ticks, bars and daily variance, changed files only.

Three tables with ledgers follow each other: ticks by file, partial bars by file, daily
variance by day. Each knows which run of the one before it has taken in, so a job that
stopped anywhere is simply run again, and a file that is corrected, emptied or late
touches its own days and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.config import PipelineConfig
from varimill.functions import day_name
from varimill.ledger import commit, current, entries, next_run, read_parts, read_run, write_parts
from varimill.operators.bars import daily_rv, merged_bars, partial_bars
from varimill.operators.scoring import Scorer, split_scored
from varimill.operators.ticks import VALID, valid_ticks
from varimill.plans.batch import daily_requests, score_requests, unscored
from varimill.schemas import DAY_ENTRY, FILE_ENTRY, PARTIAL_BAR, PARTIAL_ENTRY, SCORED, TICK
from varimill.sinks.outcomes import outcomes
from varimill.sinks.ticks import write_daily, write_file_ticks
from varimill.sources.csv import list_files, read_ticks_csv
from varimill.sources.tables import read_daily

_FILE_TICKS = T.StructType(
    [*TICK.fields, T.StructField("file_name", T.StringType()), T.StructField("day", T.StringType())]
)
_FORECASTS = T.StructType([*SCORED.fields, T.StructField("day", T.StringType())])
_FILE_BARS = T.StructType(
    [*PARTIAL_BAR.fields, T.StructField("file_name", T.StringType()), T.StructField("day", T.StringType())]
)


def changed_files(
    spark: SparkSession, csv_dir: str, table: str, from_date: str | None = None, last_n: int = 0
) -> DataFrame:
    """``file_name``, ``paths``, ``signature`` of the daily files that the table does not
    hold as they are now, among those from ``from_date`` on or the last ``last_n``.

    A file that is gone keeps what it had given; to take it back, empty it.
    """
    listed = list_files(spark, csv_dir)
    if from_date:
        listed = listed.where(F.col("file_name") >= from_date)
    if last_n > 0:
        listed = listed.orderBy(F.desc("file_name")).limit(last_n)
    known = current(spark, table, FILE_ENTRY).select(
        F.col("key").alias("file_name"), F.col("signature").alias("known")
    )
    joined = listed.join(known, "file_name", "left")
    return joined.where(~F.col("signature").eqNullSafe(F.col("known"))).drop("known")


def ingest_job(
    spark: SparkSession, csv_dir: str, table: str, config: PipelineConfig | None = None
) -> int | None:
    """Daily tick files to a tick table with a ledger; gives the number of the run,
    None if no file has changed.

    Only new and changed files are read. What such a file had left is replaced, also
    by nothing. Without ``config`` the session's settings choose the days.
    """
    config = config or PipelineConfig.from_session(spark)
    # A row per changed file: their paths go to the reader.
    changed = changed_files(spark, csv_dir, table, config.from_date, config.last_n).collect()
    if not changed:
        return None
    run_id = next_run(spark, table)
    files = [p for r in changed for p in r["paths"]]
    write_file_ticks(read_ticks_csv(spark, csv_dir, files=files), table, run_id)
    valid = F.expr("count_if(" + " AND ".join(f"({ok})" for ok in VALID.values()) + ")")
    by_day = read_run(spark, table, run_id, _FILE_TICKS).groupBy("file_name", "day").agg(
        F.count("*").alias("ticks"), valid.alias("valid"), F.min("ts").alias("low"), F.max("ts").alias("high")
    )
    by_file = by_day.groupBy("file_name").agg(
        F.sum("ticks").alias("rows"),
        F.sum("valid").alias("valid"),
        F.min("low").alias("first_ts"),
        F.max("high").alias("last_ts"),
        F.sort_array(F.collect_list(F.struct("day", "ticks", "valid"))).alias("days"),
    )
    names = spark.createDataFrame([(r["file_name"], r["signature"]) for r in changed], "file_name string, signature string")
    settled = names.join(by_file, "file_name", "left").select(
        F.col("file_name").alias("key"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "signature",
        F.coalesce("valid", F.lit(0)).alias("valid"),
        "first_ts",
        "last_ts",
        F.coalesce("days", F.array()).alias("days"),
    )
    commit(settled, table, run_id)
    return run_id


def file_counts(spark: SparkSession, table: str) -> DataFrame:
    """What ``ingest_counts`` gives for an ingested table, from its ledger alone: ticks
    per file, and the total in the row whose file is null."""
    counts = current(spark, table, FILE_ENTRY).select(F.col("key").alias("file_name"), F.col("rows").alias("n"))
    return counts.rollup("file_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ticks"))


def day_counts(spark: SparkSession, table: str) -> DataFrame:
    """``day``, ``ticks``, ``valid`` and ``files`` of an ingested table, from its ledger."""
    days = current(spark, table, FILE_ENTRY).select(F.inline("days"))
    return days.groupBy("day").agg(
        F.sum("ticks").alias("ticks"), F.sum("valid").alias("valid"), F.count("*").alias("files")
    )


def bars_job(
    spark: SparkSession, table: str, bar_table: str, config: PipelineConfig | None = None
) -> int | None:
    """Partial bars of the files that the bar table has not taken in as they are; gives
    the number of the run, None if there is none.

    A file's bars are aggregated by themselves, so no other file is read.
    """
    config = config or PipelineConfig.from_session(spark)
    taken = current(spark, bar_table, PARTIAL_ENTRY).select(F.col("key").alias("t_key"), "source_run")
    files = current(spark, table, FILE_ENTRY).join(taken, F.col("key") == F.col("t_key"), "left")
    todo = files.where(~F.col("run_id").eqNullSafe(F.col("source_run"))).drop("t_key", "source_run")
    # As small as the ledger, and asked several times.
    todo = spark.createDataFrame(todo.collect(), todo.schema)
    if todo.isEmpty():
        return None
    run_id = next_run(spark, bar_table)
    ticks = valid_ticks(read_parts(spark, table, _FILE_TICKS, todo))
    # The width divides the day, so a bar lies in the day of its ticks.
    partials = partial_bars(ticks, config.bar_width, by=("file_name", "day"))
    write_parts(partials, bar_table, run_id, "file_name", by=("day",))
    counts = read_run(spark, bar_table, run_id, _FILE_BARS).groupBy(F.col("file_name").alias("key")).agg(
        F.count("*").alias("rows"), F.sort_array(F.collect_set("day")).alias("days")
    )
    settled = todo.select("key", F.col("run_id").alias("source_run")).join(counts, "key", "left")
    commit(
        settled.select("key", F.coalesce("rows", F.lit(0)).alias("rows"), "source_run", F.coalesce("days", F.array()).alias("days")),
        bar_table,
        run_id,
    )
    return run_id


def touched_days(spark: SparkSession, bar_table: str, daily_table: str) -> DataFrame:
    """``day`` of all days whose bars have changed since the daily table was written:
    those a file has now and those it had before."""
    done = current(spark, daily_table, DAY_ENTRY).agg(F.coalesce(F.max("source_run"), F.lit(0)).alias("done"))
    history = entries(spark, bar_table, PARTIAL_ENTRY)
    before = F.lag("days").over(Window.partitionBy("key").orderBy("run_id"))
    history = history.withColumn("before", F.coalesce(before, F.array()))
    newer = history.where(F.col("run_id") > done.first()["done"])
    return newer.select(F.explode(F.concat("days", "before")).alias("day")).distinct()


def refresh_daily_job(
    spark: SparkSession, bar_table: str, daily_table: str, config: PipelineConfig | None = None
) -> list[str]:
    """Daily variance of the days whose bars have changed, from the partial bars of
    these days; gives the days."""
    config = config or PipelineConfig.from_session(spark)
    # A row per day.
    days = sorted(r["day"] for r in touched_days(spark, bar_table, daily_table).collect())
    if not days:
        return []
    run_id = next_run(spark, bar_table) - 1
    chosen = current(spark, bar_table, PARTIAL_ENTRY)
    chosen = chosen.where(F.exists("days", lambda d: d.isin(days)))
    partials = read_parts(spark, bar_table, _FILE_BARS, chosen).where(F.col("day").isin(days))
    daily = daily_rv(merged_bars(partials, config.min_ticks), config.period)
    named = spark.createDataFrame([(d,) for d in days], "day string")
    write_daily(daily, daily_table, days=named, source_run=run_id)
    return days


def touched_forecasts(daily: DataFrame, changed: list[str], monthly: int) -> DataFrame:
    """``day`` of the rows whose request depends on one of the changed days.

    A request looks back over ``monthly`` rows of its symbol, and the sequence it
    carries over as many requests. A day that is gone touches the row after it.
    """
    along = Window.partitionBy("symbol").orderBy("day")
    before = F.coalesce(F.lag("day").over(along), F.lit(""))
    days = F.array(*(F.lit(d) for d in changed))
    own = F.exists(days, lambda c: (c <= F.col("day")) & (c > F.col("_before")))
    rows = daily.select("symbol", "day", before.alias("_before")).withColumn("own", own)
    reach = along.rowsBetween(-2 * monthly, 0)
    return rows.withColumn("touched", F.max("own").over(reach)).where("touched").select("day").distinct()


def refresh_forecasts_job(
    spark: SparkSession,
    daily_table: str,
    forecast_table: str,
    scorer: Scorer | None = None,
    config: PipelineConfig | None = None,
    **options,
) -> list[str]:
    """Predictions and dead letters of the days that the changes of the daily table
    reach, in place of those they had; gives the days.

    The features of all days are made, a row per symbol and day; only those of the days
    reached are scored and written.
    """
    config = config or PipelineConfig.from_session(spark)
    last = next_run(spark, daily_table) - 1
    done = current(spark, forecast_table, DAY_ENTRY).agg(F.coalesce(F.max("source_run"), F.lit(0)).alias("done"))
    newer = entries(spark, daily_table, DAY_ENTRY).where(F.col("run_id") > done.first()["done"])
    # A row per day.
    changed = sorted(r["key"] for r in newer.select("key").distinct().collect())
    if not changed:
        return []
    daily = read_daily(spark, daily_table)
    reached = touched_forecasts(daily, changed, config.monthly).collect()
    days = sorted({r["day"] for r in reached} | set(changed))
    named = spark.createDataFrame([(d,) for d in days], "day string")
    rows = daily_requests(daily.drop("day"), config).where(day_name("(ts - 1)").isin(days))
    scored = score_requests(rows, scorer, config, **options) if config.ml_enabled else unscored(rows)
    stamped = outcomes(scored).withColumn("day", day_name("(ts - 1)"))
    run_id = next_run(spark, forecast_table)
    write_parts(stamped.repartition("day"), forecast_table, run_id, "day")
    counts = read_run(spark, forecast_table, run_id, _FORECASTS).groupBy("day").agg(F.count("*").alias("rows"))
    settled = named.join(counts, "day", "left").select(
        F.col("day").alias("key"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.lit(last).cast("long").alias("source_run"),
    )
    commit(settled, forecast_table, run_id)
    return days


def read_forecasts(spark: SparkSession, forecast_table: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, dead letters) of a table that ``refresh_forecasts_job`` keeps."""
    return split_scored(read_parts(spark, forecast_table, _FORECASTS))


def upkeep_job(
    spark: SparkSession,
    csv_dir: str,
    table: str,
    bar_table: str,
    daily_table: str,
    config: PipelineConfig | None = None,
) -> list[str]:
    """Everything from the files to daily variance, for what has changed; gives the
    days that were made anew."""
    ingest_job(spark, csv_dir, table, config)
    bars_job(spark, table, bar_table, config)
    return refresh_daily_job(spark, bar_table, daily_table, config)
