"""Times the headline queries and a full-size run; prints one JSON line.

BENCH_SF_DIR    tables to read (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default all)
BENCH_RUNS      timed runs per query after one warm-up (default 3)
BENCH_GRID      1: also the 24 cells of the published grid (input partitions 2 to
                16, shuffle partitions 2 to 12)
BENCH_CSV       1: also the full-size run from daily CSV files, through the ingested
                table, mergeable bars and the daily table to kept forecasts
BENCH_COPIES    copies of the events in the full-size run (default: enough for
                66.8 million ticks; 0 skips it)
"""

from __future__ import annotations

import json
import math
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from varimill.config import PipelineConfig  # noqa: E402
from varimill.ledger import remove_path  # noqa: E402
from varimill.operators import LstmModel, SequenceScorer, with_tick_counter  # noqa: E402
from varimill.plans import (  # noqa: E402
    bars_job,
    catalog,
    day_counts,
    file_counts,
    ingest_job,
    refresh_daily_job,
    refresh_forecasts_job,
    scored_requests,
    sweep,
)
from varimill.session import RECOMMENDED  # noqa: E402
from varimill.sinks import read_predictions, write_scored, write_ticks_csv  # noqa: E402
from varimill.sources import read_table, read_ticks, ticks_from_events  # noqa: E402
from varimill.workspace import run_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BASELINE_TICKS = 66_820_195
SYMBOL_GROUPS = 12  # with five event types: 60 symbols
MONTHS = 3

HEADLINE = (
    "valid_ticks",
    "bars_5m",
    "daily_rv",
    "daily_rv_one_symbol",
    "rv_features",
    "request_payloads",
    "model_sequences",
    "har_predictions",
    "scored_status",
    "lstm_scores",
    "predictions_by_symbol",
    "ingest_counts",
    "csv_daily_files",
)


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(CPUS))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def copies_of_events(spark: SparkSession, copies: int, path: str) -> None:
    """Ticks of 60 symbols over 90 days: the events, copied with shifted times.

    Files follow event time, as daily files and topics do.
    """
    events = read_table(spark, SF_DIR, "events").repartitionByRange(2 * CPUS, "ts")
    copy = F.col("copy")
    shift_ms = F.floor(copy / SYMBOL_GROUPS) % MONTHS * (30 * 86_400_000) + copy * 7
    ticks = ticks_from_events(events).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    ticks.select(
        F.concat_ws("_", "symbol", (copy % SYMBOL_GROUPS).cast("string")).alias("symbol"),
        (F.col("ts") + shift_ms).alias("ts"),
        "bid",
        "ask",
        "volume",
        "spread",
        (F.col("seq") * copies + copy).alias("seq"),
    ).write.parquet(path)


def full_size(spark: SparkSession, copies: int) -> dict:
    """Stored ticks to stored predictions, LSTM scoring included.

    Not like for like with the published runs: the ticks are Parquet, copies of one
    small table, and the model runs in process.
    """
    base = run_dir(spark, "bench")
    copies_of_events(spark, copies, f"{base}/ticks")
    scorer = SequenceScorer(lstm=LstmModel.from_seed(7))
    best, seen, predictions = math.inf, 0, 0
    for i in range(3):
        counter = Observation("ticks")
        ticks = with_tick_counter(spark.read.parquet(f"{base}/ticks"), counter)
        out = f"{base}/out-{i}"
        best = min(best, timed(lambda: write_scored(scored_requests(ticks, scorer), 0, out, 4)))
        seen, predictions = counter.get["ticks"], read_predictions(spark, out).count()
    result = {
        "grid": grid(spark, f"{base}/ticks", scorer, base) if os.environ.get("BENCH_GRID") == "1" else None,
        "csv": from_files(spark, f"{base}/ticks", scorer, base) if os.environ.get("BENCH_CSV") == "1" else None,
        "source": "parquet",
        "copies": copies,
        "ticks": seen,
        "predictions": predictions,
        "elapsed_sec": round(best, 3),
        "ticks_per_sec": round(seen / best, 2),
        "cores": CPUS,
        "driver_memory": spark.conf.get("spark.driver.memory"),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    remove_path(spark, base)
    return result


def from_files(spark: SparkSession, ticks_path: str, scorer: SequenceScorer, base: str) -> dict:
    """Daily CSV files to forecasts, each table stored on the way; then once more after
    one file has lost its ticks."""
    csv, table, bars, daily, kept = (f"{base}/{d}" for d in ("csv", "ingested", "bars", "daily", "forecasts"))
    write_ticks_csv(spark.read.parquet(ticks_path), csv)
    config = PipelineConfig()

    def upkeep() -> dict:
        steps = {
            "ingest": lambda: ingest_job(spark, csv, table, config),
            "bars": lambda: bars_job(spark, table, bars, config),
            "days": lambda: refresh_daily_job(spark, bars, daily, config),
            "forecasts": lambda: refresh_forecasts_job(spark, daily, kept, scorer, config),
        }
        return {name: round(timed(step), 2) for name, step in steps.items()}

    whole = upkeep()
    seen = file_counts(spark, table).where("file_name IS NULL").first()["ticks"]
    day = day_counts(spark, table).orderBy("day").limit(40).agg(F.max("day")).first()[0]
    few = read_ticks(spark, table, from_date=day).where(F.col("day") == day).limit(1000)
    write_ticks_csv(few, csv, "overwrite", day=day)
    total = sum(whole.values())
    return {"ticks": seen, "elapsed_sec": round(total, 2), "ticks_per_sec": round(seen / total, 2), "steps": whole, "after_one_correction": upkeep()}


def grid(spark: SparkSession, path: str, scorer: SequenceScorer, base: str) -> list[dict]:
    """One run per cell of input and shuffle partitions."""

    def run(inputs: int) -> int:
        counter = Observation("ticks")
        ticks = with_tick_counter(spark.read.parquet(path).coalesce(inputs), counter)
        write_scored(scored_requests(ticks, scorer), 0, f"{base}/grid", 4)
        return counter.get["ticks"]

    runs = sweep(spark, run, (2, 4, 8, 16), (2, 4, 6, 8, 10, 12))
    names = ("input_partitions", "parallelism", "elapsed_ms", "throughput_ticks_per_sec", "error")
    return [dict(zip(names, row, strict=True)) for row in runs.select(*names).collect()]


def main() -> None:
    spark = session()
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        run(queries[name](spark, SF_DIR))
        times = [timed(lambda: run(queries[name](spark, SF_DIR))) for _ in range(RUNS)]
        seconds[name] = round(statistics.median(times), 4)
    events = read_table(spark, SF_DIR, "events").count()
    copies = int(os.environ.get("BENCH_COPIES", math.ceil(BASELINE_TICKS / events)))
    result = {
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
        "events": events,
    }
    if copies:
        result["full_size"] = full_size(spark, copies)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
