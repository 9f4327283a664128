"""Every operator as a query over the given tables.

Doubles are rounded in the results, because engines add in different orders.
The event log stands in for ticks, one symbol per event type.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varimill.config import PipelineConfig
from varimill.functions import day_name, event_time
from varimill.operators import (
    LstmModel,
    Outcome,
    SequenceScorer,
    daily_rv,
    first_requests,
    gate,
    head_ordered,
    ingest_counts,
    invalid_reasons,
    log_return_bars,
    merged_bars,
    model_requests,
    model_sequences,
    parse_responses,
    partial_bars,
    predictions_by_symbol,
    predictions_with_model,
    replay,
    request_payloads,
    rv_features,
    score,
    select_days,
    split_scored,
    tick_counts,
    valid_ticks,
    with_throughput,
    with_tick_counter,
)
from varimill.operators.scoring import ERROR, INVALID, OK
from varimill.plans import batch, streams
from varimill.plans.ingest import (
    day_counts,
    file_counts,
    ingest_job,
    read_forecasts,
    refresh_forecasts_job,
    upkeep_job,
)
from varimill.plans.jobs import daily_forecast_job, daily_job, replay_job, stream_forecast_job
from varimill.plans.sweep import sweep
from varimill.schemas import SCORED, TICK
from varimill.sinks import (
    append_metrics,
    compact_predictions,
    read_dead_letters,
    read_metrics,
    read_predictions,
    write_bars_bucketed,
    write_daily,
    write_scored,
    write_ticks,
    write_ticks_csv,
)
from varimill.sources import (
    read_daily,
    read_table,
    read_ticks,
    read_ticks_csv,
    stream_table,
    ticks_from_events,
    ticks_from_fields,
)
from varimill.streaming import (
    available_now,
    batch_counts,
    corrected_bars,
    keep_bars,
    kept_bars,
    late_rows,
)
from varimill.workspace import run_dir

Query = Callable[[SparkSession, str], DataFrame]
TEST_START = date(2024, 1, 25)
FROM_DATE = "2024-01-05"
LAST_N = 20
BUCKETS = 8  # of stored bars: a table's bucket count must not follow the cluster
INFINITE_DAY_MS = 1704499200000  # the day that ends at 2024-01-06 00:00 UTC
_WEEKDAY_SQL = "ts div 86400000 % 7"
HOUR = PipelineConfig().bar_width * 12


def ticks(
    spark: SparkSession, sf_dir: str, symbol: str = "event_type", from_date: str | None = None
) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ticks_from_events(read_table(spark, sf_dir, "events"), symbol, from_date)


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ticks_from_events(stream_table(spark, sf_dir, "events"))


def _daily(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    return batch.daily_variance(ticks(spark, sf_dir, symbol))


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.selectExpr(
        *(f"round({n}, {digits}) AS {n}" if t == "double" else n for n, t in df.dtypes)
    )


# Sources


def q_ticks_from_events(spark, sf_dir):
    return _rounded(ticks(spark, sf_dir))


def q_csv_fields_typed(spark, sf_dir):
    """Six text fields made from the events, some of them broken on purpose."""
    n = F.col("seq")
    clock = F.date_format(event_time("ts"), "yyyyMMdd HH:mm:ss.SSS")
    when = (
        F.when(n % 17 == 0, F.lit("2024-01-01T00:00"))
        .when(n % 3 == 0, F.col("ts").cast("string"))
        .when(n % 3 == 1, F.concat(F.lit("\t"), clock, F.lit("  ")))
        .otherwise(clock)
    )
    fields = ticks(spark, sf_dir).select(
        when.alias("datetime"),
        F.when(n % 19 == 0, F.lit("1,5")).otherwise(F.col("bid").cast("string")).alias("bid"),
        F.when(n % 23 == 0, F.lit("inf")).otherwise(F.col("ask").cast("string")).alias("ask"),
        F.concat(F.lit(" "), F.col("volume").cast("string"), F.lit("d")).alias("volume"),
        F.when(n % 29 == 0, F.lit(None)).otherwise(F.col("spread").cast("string")).alias("spread"),
        F.when(n % 31 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("  "), "symbol", F.lit("\t")))
        .alias("symbol"),
        "seq",
    )
    return _rounded(ticks_from_fields(fields).select(*TICK.names))


def q_csv_daily_files(spark, sf_dir):
    """Write daily tick files, read the selected days back."""
    path = run_dir(spark, "csv")
    write_ticks_csv(ticks(spark, sf_dir), path)
    back = read_ticks_csv(spark, path, from_date=FROM_DATE, last_n=LAST_N)
    return _rounded(back.drop("seq"))


def q_ingest_window(spark, sf_dir):
    named = ticks(spark, sf_dir, from_date=FROM_DATE).withColumn("day", day_name())
    return _rounded(select_days(named, last_n=LAST_N, col="day"))


def q_ingest_counts(spark, sf_dir):
    named = ticks(spark, sf_dir).withColumn("day", day_name())
    counts = ingest_counts(named, by="day")
    return counts.select(F.coalesce("day", F.lit("total")).alias("day"), "ticks")


def q_tick_day_table(spark, sf_dir):
    """Write the day-partitioned tick table, read it from a day on."""
    path = run_dir(spark, "ticks")
    write_ticks(ticks(spark, sf_dir), path)
    back = read_ticks(spark, path, from_date=FROM_DATE)
    return _rounded(back.select(*TICK.names, "day"))


# Ticks


def q_valid_ticks(spark, sf_dir):
    return _rounded(valid_ticks(ticks(spark, sf_dir)))


def q_invalid_tick_reasons(spark, sf_dir):
    bad = invalid_reasons(ticks(spark, sf_dir))
    return bad.select("symbol", "ts", "seq", F.array_join("reasons", ",").alias("reasons"))


def q_tick_counter(spark, sf_dir):
    return tick_counts(ticks(spark, sf_dir))


# Bars and days


def _bars(spark, sf_dir, **kw):
    bars = log_return_bars(valid_ticks(ticks(spark, sf_dir)), **kw)
    return _rounded(bars.select("symbol", "ts", "log_return", "n_ticks"))


def q_bars_5m(spark, sf_dir):
    return _bars(spark, sf_dir)


def q_bars_60m(spark, sf_dir):
    return _bars(spark, sf_dir, width=HOUR)


def q_daily_rv(spark, sf_dir):
    return _rounded(_daily(spark, sf_dir))


def q_daily_rv_one_symbol(spark, sf_dir):
    return _rounded(_daily(spark, sf_dir, "'ALL'"))


def q_daily_rv_60m(spark, sf_dir):
    return _rounded(daily_rv(log_return_bars(valid_ticks(ticks(spark, sf_dir)), HOUR)))


def q_bucketed_daily_rv(spark, sf_dir):
    """Daily variance from stored bars, bucketed by symbol."""
    table, path = "varimill_bars", run_dir(spark, "bars")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    bars = log_return_bars(valid_ticks(ticks(spark, sf_dir)))
    write_bars_bucketed(bars, table, BUCKETS, path=path)
    return _rounded(daily_rv(spark.table(table)))


# Features and requests


def q_rv_features(spark, sf_dir):
    return _rounded(rv_features(_daily(spark, sf_dir)))


def q_rv_features_gated(spark, sf_dir):
    return _rounded(gate(rv_features(_daily(spark, sf_dir)), TEST_START))


def q_first_requests(spark, sf_dir):
    return _rounded(first_requests(_daily(spark, sf_dir), TEST_START))


def q_request_payloads(spark, sf_dir):
    requests = request_payloads(_daily(spark, sf_dir), TEST_START)
    return requests.select("symbol", "ts", "is_first", "payload")


def q_model_sequences(spark, sf_dir):
    """One row per request and step of its model input."""
    steps = model_sequences(_daily(spark, sf_dir), TEST_START).select(
        "symbol", "ts", F.posexplode("sequence").alias("step", "t")
    )
    # The values have the payload's decimals; rounding them again would make ties.
    return steps.select(
        "symbol",
        "ts",
        "step",
        F.col("t")[0].alias("rv_daily"),
        F.col("t")[1].alias("rv_weekly"),
        F.col("t")[2].alias("rv_monthly"),
    )


# Scoring


@dataclass(frozen=True)
class DayRuleScorer:
    """A stand-in service whose answer follows from the day of the request.

    Of each week of days, one is refused, one is down, one recovers on replay.
    """

    recovered: bool = False

    def __call__(self, requests: pa.RecordBatch) -> Outcome:
        days = np.asarray(requests.column("ts")) // 86_400_000 % 7
        status = np.full(len(days), OK, dtype=object)
        status[days == 0] = INVALID
        status[days == 1] = ERROR
        if not self.recovered:
            status[days == 2] = ERROR
        return Outcome(status, np.full(len(days), np.nan), days * 0.5)


def _scored(spark, sf_dir):
    return score(
        model_requests(_daily(spark, sf_dir)),
        DayRuleScorer(),
        backoff_ms=0,
        breaker_threshold=None,
    )


def _forecasts(spark, sf_dir, **kw):
    return batch.forecasts(ticks(spark, sf_dir), PipelineConfig(**kw))


def q_har_predictions(spark, sf_dir):
    return _rounded(_forecasts(spark, sf_dir), 6)


def q_har_predictions_one_symbol(spark, sf_dir):
    return _rounded(batch.forecasts(ticks(spark, sf_dir, "'ALL'")), 6)


def q_bypass_predictions(spark, sf_dir):
    return _rounded(_forecasts(spark, sf_dir, ml_enabled=False), 6)


def q_scored_status(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return _rounded(scored.select("symbol", "ts", "status", "attempts", "lstm_pred", "har_pred"), 6)


def q_dead_letters(spark, sf_dir):
    _, dead = split_scored(_scored(spark, sf_dir))
    return dead.select("symbol", "ts", "payload", "reason", F.size("sequence").alias("steps"))


def q_replayed(spark, sf_dir):
    """Dead letters scored once more by a service that has half recovered."""
    _, dead = split_scored(_scored(spark, sf_dir))
    again = replay(dead, DayRuleScorer(recovered=True))
    names = ("symbol", "ts", "status", "attempts", "lstm_pred", "har_pred")
    return _rounded(again.select(*names), 6)


def q_stored_predictions(spark, sf_dir):
    """Predictions and dead letters through the store, each on its side."""
    root = run_dir(spark, "outcomes")
    write_scored(_scored(spark, sf_dir), 0, root, partitions=4)
    predictions = read_predictions(spark, root).select(
        "symbol", "ts", F.lit("prediction").alias("side"), "har_pred"
    )
    letters = read_dead_letters(spark, root).select(
        "symbol", "ts", F.col("reason").alias("side"), F.lit(None).cast("double").alias("har_pred")
    )
    return _rounded(predictions.unionByName(letters), 6)


def q_responses_parsed(spark, sf_dir):
    """Response texts made from the forecasts, some without the required number."""
    texts = _forecasts(spark, sf_dir).selectExpr(
        "symbol",
        "ts",
        """to_json(named_struct(
             'symbol', symbol, 'lstm', if(ts / 86400000 % 2 = 0, 0.5D, NULL),
             'har', if(ts / 86400000 % 5 = 0, NULL, round(har_pred, 6)), 'device', 'cpu'),
           map('ignoreNullFields', 'false')) AS response""",
    )
    return parse_responses(texts).drop("response")


SMALL_LSTM = LstmModel.from_seed(7, hidden=4, dtype=np.float64)


def _lstm_scored(spark, sf_dir, length=22):
    scorer = SequenceScorer(lstm=SMALL_LSTM, length=length)
    return score(model_requests(_daily(spark, sf_dir)), scorer)


def q_lstm_scores(spark, sf_dir):
    predictions, _ = split_scored(_lstm_scored(spark, sf_dir))
    return _rounded(predictions, 6)


def q_short_sequences(spark, sf_dir):
    """A model that wants a longer history than there is: no output, no failure."""
    predictions, _ = split_scored(_lstm_scored(spark, sf_dir, length=23))
    return _rounded(predictions, 6)


def q_nonfinite_days(spark, sf_dir):
    """An infinite day stays in the averages; requests that see it are refused."""
    daily = _daily(spark, sf_dir).selectExpr(
        "symbol", "ts", f"if(ts = {INFINITE_DAY_MS}L, double('Infinity'), rv_daily) AS rv_daily"
    )
    requests = score(model_requests(daily))
    return _rounded(requests.select("symbol", "ts", "status", "rv_monthly", "har_pred"), 6)


def q_invalid_requests(spark, sf_dir):
    """Requests with missing and non-finite numbers are refused before any scorer."""
    odd = model_requests(_daily(spark, sf_dir)).selectExpr(
        "symbol",
        "ts",
        f"CASE {_WEEKDAY_SQL} WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE rv_daily END AS rv_daily",
        f"if({_WEEKDAY_SQL} = 2, double('-Infinity'), rv_weekly) AS rv_weekly",
        "rv_monthly",
        "payload",
        "sequence",
    )
    return score(odd, AlwaysScorer()).select("symbol", "ts", "status", "attempts")


@dataclass(frozen=True)
class AlwaysScorer:
    """A stand-in service with one answer, or one exception, for everything."""

    status: str = OK
    message: str | None = None

    def __call__(self, requests: pa.RecordBatch) -> Outcome:
        if self.message:
            raise RuntimeError(self.message)
        n = requests.num_rows
        return Outcome(np.full(n, self.status, dtype=object), np.full(n, np.nan), np.full(n, 0.5))


@dataclass
class SlowService:
    """A stand-in service and its clock: by the weekday of its day a request takes 4 s, 12 s
    at the first attempt and then 1 s, always 12 s, or 31 s."""

    now: float = 0.0
    asked: dict | None = None

    def clock(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def __call__(self, requests: pa.RecordBatch) -> Outcome:
        self.asked = self.asked or {}
        for symbol, ts in zip(requests.column("symbol").to_pylist(), requests.column("ts").to_pylist()):
            times = self.asked[symbol, ts] = self.asked.get((symbol, ts), 0) + 1
            self.now += {0: 4, 1: 12 if times == 1 else 1, 2: 12}.get(ts // 86_400_000 % 4, 31)
        n = requests.num_rows
        return Outcome(np.full(n, OK, dtype=object), np.full(n, np.nan), np.full(n, 0.5))


def q_slow_service(spark, sf_dir):
    """One request a call, 10 s for a call and 30 s for all attempts, on a clock that
    only the service moves."""
    service = SlowService()
    scored = score(
        model_requests(_daily(spark, sf_dir)),
        service,
        capacity=1,
        breaker_threshold=None,
        call_timeout_s=10.0,
        total_timeout_s=30.0,
        clock=service.clock,
        sleep=service.sleep,
    )
    return scored.select("symbol", "ts", "status", "attempts", "lstm_pred", "error")


def q_calls_in_flight(spark, sf_dir):
    """Eight calls of a task at a time answer what one at a time does."""
    scored = score(
        model_requests(_daily(spark, sf_dir)),
        DayRuleScorer(),
        backoff_ms=0,
        breaker_threshold=None,
        capacity=1,
        in_flight=8,
    )
    return _rounded(scored.select("symbol", "ts", "status", "attempts", "lstm_pred", "har_pred"), 6)


def q_raising_scorer(spark, sf_dir):
    scored = score(
        model_requests(_daily(spark, sf_dir)),
        AlwaysScorer(message="out of order"),
        backoff_ms=0,
        breaker_threshold=None,
    )
    return scored.select("symbol", "ts", "status", "attempts", "error")


def q_breaker_open(spark, sf_dir):
    """One task, one request a call, time standing still: after five failures nothing is sent."""
    scored = score(
        model_requests(_daily(spark, sf_dir)),
        AlwaysScorer(ERROR),
        backoff_ms=0,
        capacity=1,
        partitions=1,
        clock=_no_time,
    )
    return scored.groupBy("status", "attempts").agg(F.count("*").alias("requests"))


def _no_time() -> float:
    return 0.0


def _never_ready() -> bool:
    return False


def q_service_not_ready(spark, sf_dir):
    scored = score(
        model_requests(_daily(spark, sf_dir)), AlwaysScorer(), is_ready=_never_ready, ready_timeout_s=0.0
    )
    return scored.select("symbol", "ts", "status", "attempts")


def q_broken_payloads(spark, sf_dir):
    """Letters whose text is cut, lacks a field or has one of another type."""
    _, dead = split_scored(_scored(spark, sf_dir))
    texts = dead.selectExpr(
        "symbol",
        "ts",
        f"""CASE {_WEEKDAY_SQL} WHEN 0 THEN substring(payload, 1, 30)
            WHEN 1 THEN replace(payload, 'rv_weekly', 'rv_other')
            ELSE replace(payload, '"rv_daily":', '"rv_daily":[],"x":') END AS payload""",
    )
    return replay(texts, AlwaysScorer()).select("symbol", "ts", "status", "attempts")


def q_replayed_at_processing_time(spark, sf_dir):
    _, dead = split_scored(_scored(spark, sf_dir))
    again = replay(dead, DayRuleScorer(recovered=True), ts_mode="processing")
    late = (F.col("ts") == F.unix_millis("replayed_at")).alias("at_replay")
    return again.select("symbol", "letter_ts", late)


def q_prediction_rows(spark, sf_dir):
    """Rows as the predictions table holds them, without the clock column and the id."""
    root = run_dir(spark, "rows")
    write_scored(score(model_requests(_daily(spark, sf_dir))), 0, root)
    rows = read_predictions(spark, root)
    stamped = F.col("created_at").isNotNull().alias("stamped")
    ids = (F.col("id") == F.xxhash64("symbol", "ts")).alias("id_of_key")
    return _rounded(rows.withColumns({"stamped": stamped, "id_of_key": ids}).drop("id", "created_at"), 6)


def q_store_after_replay(spark, sf_dir):
    """A replay into its own store: what it settles becomes predictions, twice run or not."""
    root, checkpoint = run_dir(spark, "store"), run_dir(spark, "checkpoint")
    write_scored(_scored(spark, sf_dir), 0, root, partitions=4)
    for _ in range(2):
        replay_job(spark, root, None, checkpoint, DayRuleScorer(recovered=True))
    predictions = read_predictions(spark, root).select(
        "symbol", "ts", F.lit("prediction").alias("side"), "lstm_pred"
    )
    letters = read_dead_letters(spark, root).select(
        "symbol", "ts", F.col("reason").alias("side"), F.lit(None).cast("double").alias("lstm_pred")
    )
    return _rounded(predictions.unionByName(letters), 6)


def q_ingested_twice(spark, sf_dir):
    """Daily files to the tick table, the whole directory, and once more: no tick doubles."""
    files, table = run_dir(spark, "csv"), run_dir(spark, "ticks")
    write_ticks_csv(ticks(spark, sf_dir), files)
    for config in (PipelineConfig(), PipelineConfig(from_date=FROM_DATE)):
        ingest_job(spark, files, table, config)
    return _rounded(read_ticks(spark, table).drop("seq"))


SHRUNK, EMPTIED, SPLIT, LATE = "2024-01-08", "2024-01-09", "2024-01-10", "2024-02-15"


def _corrected(spark, sf_dir, config=PipelineConfig()) -> tuple[str, list[str]]:
    """Daily files taken in; then one loses a third of its ticks, one all of them, and a
    late file brings a fifth of another day's; taken in again. The tables' folder, and
    the days made anew."""
    root = run_dir(spark, "upkeep")
    tables = [f"{root}/{t}" for t in ("csv", "ticks", "bars", "daily")]
    rows = ticks(spark, sf_dir).withColumn("d", day_name())
    late = (F.col("d") == SPLIT) & (F.col("seq") % 5 == 0)
    write_ticks_csv(rows.where(~late), tables[0])
    upkeep_job(spark, *tables, config)
    write_ticks_csv(rows.where((F.col("d") == SHRUNK) & (F.col("seq") % 3 != 0)), tables[0], "overwrite", day=SHRUNK)
    # Its only line is none that counts.
    broken = rows.limit(1).withColumn("symbol", F.lit(None).cast("string"))
    write_ticks_csv(broken, tables[0], "overwrite", day=EMPTIED)
    write_ticks_csv(rows.where(late), tables[0], "append", day=LATE)
    return root, upkeep_job(spark, *tables, config)


def q_corrected_files(spark, sf_dir):
    """The ticks of files that were corrected, emptied and late, without leftovers."""
    root, _ = _corrected(spark, sf_dir)
    return _rounded(read_ticks(spark, f"{root}/ticks").drop("seq"))


def q_corrected_counts(spark, sf_dir):
    """Ticks per file and in all, as the ledger has them."""
    root, _ = _corrected(spark, sf_dir)
    counts = file_counts(spark, f"{root}/ticks")
    return counts.select(F.coalesce("file_name", F.lit("total")).alias("file_name"), "ticks")


def q_corrected_days(spark, sf_dir):
    """Ticks per day from the ledger, and whether the second run made the day anew."""
    root, days = _corrected(spark, sf_dir)
    counts = day_counts(spark, f"{root}/ticks")
    return counts.withColumn("anew", F.col("day").isin(days))


def q_corrected_daily_rv(spark, sf_dir):
    """Daily variance kept up from mergeable bars, after the corrections."""
    root, _ = _corrected(spark, sf_dir)
    return _rounded(read_daily(spark, f"{root}/daily").drop("day"))


def q_corrected_forecasts(spark, sf_dir):
    """Forecasts kept up with the corrections: made for all days, then made anew for the
    days whose history has changed."""
    root = run_dir(spark, "upkeep")
    csv, table, bars, daily, kept = (f"{root}/{t}" for t in ("csv", "ticks", "bars", "daily", "forecasts"))
    config = PipelineConfig()
    rows = ticks(spark, sf_dir).withColumn("d", day_name())
    write_ticks_csv(rows, csv)
    upkeep_job(spark, csv, table, bars, daily, config)
    refresh_forecasts_job(spark, daily, kept, config=config)
    write_ticks_csv(rows.where((F.col("d") == SHRUNK) & (F.col("seq") % 3 != 0)), csv, "overwrite", day=SHRUNK)
    write_ticks_csv(rows.limit(1).withColumn("symbol", F.lit(None).cast("string")), csv, "overwrite", day=EMPTIED)
    upkeep_job(spark, csv, table, bars, daily, config)
    refresh_forecasts_job(spark, daily, kept, config=config)
    predictions, _ = read_forecasts(spark, kept)
    return _rounded(predictions, 6)


def q_compacted_store(spark, sf_dir):
    """Two runs over the same days and a replay, then one batch of what counts."""
    root, checkpoint = run_dir(spark, "store"), run_dir(spark, "checkpoint")
    for run_id in range(2):
        write_scored(_scored(spark, sf_dir), run_id, root, partitions=4)
    replay_job(spark, root, None, checkpoint, DayRuleScorer(recovered=True))
    compact_predictions(spark, root)
    predictions = read_predictions(spark, root).select("symbol", "ts", F.lit("prediction").alias("side"), "lstm_pred")
    letters = read_dead_letters(spark, root).select(
        "symbol", "ts", F.col("reason").alias("side"), F.lit(None).cast("double").alias("lstm_pred")
    )
    return _rounded(predictions.unionByName(letters.distinct()), 6)


def q_bars_merged(spark, sf_dir):
    """Bars from partial ones of three parts of the ticks, dealt without regard to time."""
    rows = ticks(spark, sf_dir).withColumn("part", F.col("seq") % 3)
    bars = merged_bars(partial_bars(valid_ticks(rows), by=("part",)))
    return _rounded(bars)


def q_incremental_forecast(spark, sf_dir):
    """Daily variance kept as a table, extended by the last days; forecasts from it."""
    table, daily, root = (run_dir(spark, d) for d in ("ticks", "daily", "store"))
    write_ticks(ticks(spark, sf_dir), table)
    daily_job(spark, table, daily, config=PipelineConfig())
    daily_job(spark, table, daily, from_date="2024-01-24", config=PipelineConfig())
    for run_id, day in ((0, None), (1, "2024-01-25")):
        daily_forecast_job(spark, daily, root, run_id, from_date=day, config=PipelineConfig())
    return _stored_forecasts(spark, root)


# Reports


def q_predictions_by_symbol(spark, sf_dir):
    return predictions_by_symbol(_forecasts(spark, sf_dir))


def q_predictions_with_model(spark, sf_dir):
    predictions, _ = split_scored(_lstm_scored(spark, sf_dir))
    return predictions_with_model(predictions, "lstm_pred", "mamba_pred")


def q_predictions_head(spark, sf_dir):
    return _rounded(head_ordered(_forecasts(spark, sf_dir)), 6)


def _runs_by_day(spark, sf_dir):
    """Each day of ticks as one run: how many, over which span of time."""
    spans = (
        ticks(spark, sf_dir)
        .groupBy(day_name().alias("run_timestamp"))
        .agg(
            F.count(F.lit(1)).alias("total_ticks"),
            (F.max("ts") - F.min("ts")).alias("elapsed_ms"),
        )
    )
    return spans.select(
        "run_timestamp",
        F.lit(8).alias("parallelism"),
        F.lit(16).alias("input_partitions"),
        F.lit(60000).cast("long").alias("checkpoint_ms"),
        F.lit(True).alias("ml_enabled"),
        "total_ticks",
        "elapsed_ms",
    )


def q_throughput(spark, sf_dir):
    return _rounded(with_throughput(_runs_by_day(spark, sf_dir)), 6)


def q_run_metrics(spark, sf_dir):
    """Run rows through the metrics store."""
    path = run_dir(spark, "metrics")
    append_metrics(_runs_by_day(spark, sf_dir), path)
    return read_metrics(spark, path)


def q_parallelism_sweep(spark, sf_dir):
    """The pipeline at each setting; times vary, tick counts do not."""

    def run(input_partitions: int) -> int:
        seen = Observation("ticks")
        source = with_tick_counter(ticks(spark, sf_dir).repartition(input_partitions), seen)
        batch.forecasts(source).write.format("noop").mode("overwrite").save()
        return seen.get["ticks"]

    runs = sweep(spark, run, input_partitions=(2, 8), shuffle_partitions=(4, 8))
    return runs.select("input_partitions", "parallelism", "total_ticks")


# Streams


def q_stream_daily_rv(spark, sf_dir):
    return _rounded(streams.stream_daily_rv(_tick_stream(spark, sf_dir)))


def q_stream_requests(spark, sf_dir):
    config = PipelineConfig(test_start=TEST_START)
    requests = streams.stream_to_requests(_tick_stream(spark, sf_dir), config)
    return requests.select("symbol", "ts", "is_first", "payload")


def q_stream_from_history(spark, sf_dir):
    """A stream that starts at day 24, with the days before from the batch table: it
    gives requests from its first day on, and those that batch gives."""
    first, second, third = _slices(spark, sf_dir)
    daily, root, base = (run_dir(spark, d) for d in ("daily", "store", "stream"))
    write_daily(batch.daily_variance(first.unionByName(second)), daily)
    landing = run_dir(spark, "landing")
    third.write.parquet(landing)
    rows = spark.readStream.schema(TICK).parquet(landing)
    stream_forecast_job(
        spark, rows, root, base, config=PipelineConfig(), flush=True, history=read_daily(spark, daily).drop("day")
    )
    return _stored_forecasts(spark, root)


def q_stream_replayed(spark, sf_dir):
    """Dead letters read as a stream from the store and replayed."""
    store, replayed, checkpoint = (run_dir(spark, d) for d in ("store", "replayed", "checkpoint"))
    write_scored(_scored(spark, sf_dir), 0, store, partitions=4)
    replay_job(spark, store, replayed, checkpoint, DayRuleScorer(recovered=True))
    names = ("symbol", "ts", "status", "attempts", "lstm_pred", "har_pred")
    return _rounded(spark.read.schema(SCORED).parquet(replayed).select(*names), 6)


def _slices(spark, sf_dir) -> list[DataFrame]:
    """The ticks in three parts by time, cut between days."""
    rows = ticks(spark, sf_dir).withColumn("day", day_name())
    days = (("", "2024-01-11"), ("2024-01-11", "2024-01-24"), ("2024-01-24", "9"))
    return [rows.where((F.col("day") >= a) & (F.col("day") < b)).drop("day") for a, b in days]


def _landed(spark, path: str) -> DataFrame:
    return spark.readStream.schema(TICK).parquet(path)


def _stored_forecasts(spark, root: str) -> DataFrame:
    return _rounded(read_predictions(spark, root).drop("id", "created_at"), 6)


FAR_MS = 1893456000000  # 2030-01-01 00:00 UTC


def _out_of_order(spark, sf_dir) -> list[DataFrame]:
    """Ticks in three deliveries: every eleventh tick of the first third of time comes
    with the last one."""
    first, second, third = _slices(spark, sf_dir)
    behind = F.col("seq") % 11 == 0
    return [first.where(~behind), second, third.unionByName(first.where(behind))]


def _deliver(spark, parts: list[DataFrame], **options) -> str:
    """One run of a keeping stream per delivery, on one checkpoint; the kept tables."""
    base = run_dir(spark, "kept")
    landing, root, checkpoint = (f"{base}/{d}" for d in ("landing", "tables", "checkpoint"))
    write = keep_bars(root, **options)
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(f"{landing}/delivery={number}")
        stream = spark.readStream.schema(TICK).parquet(f"{landing}/delivery=*")
        available_now(stream.select(*TICK.names), write, checkpoint)
    return root


def q_stream_late_ticks(spark, sf_dir):
    """Ticks that came after their bar was closed, as rows."""
    return _rounded(late_rows(spark, _deliver(spark, _out_of_order(spark, sf_dir))).drop("spread"))


def q_stream_kept_bars(spark, sf_dir):
    """Bars of the ticks that came in time."""
    return _rounded(kept_bars(spark, _deliver(spark, _out_of_order(spark, sf_dir)), still_open=True))


def q_stream_corrected_bars(spark, sf_dir):
    """The same bars with the late ticks: those of all ticks."""
    return _rounded(corrected_bars(spark, _deliver(spark, _out_of_order(spark, sf_dir)), still_open=True))


def q_stream_batch_counts(spark, sf_dir):
    """Ticks, valid and late ones and the mark of every micro-batch, from the ledger."""
    return batch_counts(spark, _deliver(spark, _out_of_order(spark, sf_dir)))


def q_stream_two_sources(spark, sf_dir):
    """Two sources, one a delivery behind the other: the mark waits, no tick is late."""
    first, second, third = _slices(spark, sf_dir)
    slow = F.col("seq") % 2 == 0
    parts = [first.where(~slow), second.where(~slow).unionByName(first.where(slow)), third.unionByName(second.where(slow))]
    root = _deliver(spark, parts, source="if(seq % 2 = 0, 'slow', 'fast')", expected=("fast", "slow"))
    late = late_rows(spark, root).select("symbol", "ts", F.lit(None).cast("double").alias("log_return"), F.lit(1).cast("long").alias("n_ticks"))
    return _rounded(kept_bars(spark, root, still_open=True).unionByName(late))


def q_stream_moved_by_all(spark, sf_dir):
    """An invalid tick of the far future moves time where all ticks do: whatever valid
    tick comes after it is late."""
    first, second, third = _slices(spark, sf_dir)
    far = first.limit(1).withColumns({"ts": F.lit(FAR_MS), "bid": F.lit(-1.0)})
    root = _deliver(spark, [first.unionByName(far), second, third], moved_by="all")
    return batch_counts(spark, root)


def q_stream_predictions(spark, sf_dir):
    """Ticks in three micro-batches, one to a run, to stored predictions; only the last
    run closes its days."""
    path, base, root = (run_dir(spark, d) for d in ("landing", "stream", "store"))
    parts = _slices(spark, sf_dir)
    for number, part in enumerate(parts, 1):
        part.write.mode("append").parquet(path)
        flush = number == len(parts)
        stream_forecast_job(spark, _landed(spark, path), root, base, config=PipelineConfig(), flush=flush)
    return _stored_forecasts(spark, root)


def q_stream_continued(spark, sf_dir):
    """The same with a flush after each part: a stream goes on and loses nothing."""
    path, base, root = (run_dir(spark, d) for d in ("landing", "stream", "store"))
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(path)
        stream_forecast_job(spark, _landed(spark, path), root, base, config=PipelineConfig(), flush=True)
    return _stored_forecasts(spark, root)


def queries() -> dict[str, Query]:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
