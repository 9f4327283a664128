import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from varimill.config import PipelineConfig
from varimill.operators import Outcome
from varimill.plans import (
    daily_forecast_job,
    daily_job,
    forecast_job,
    forecasts,
    ingest_job,
    replay_job,
    sweep,
)
from varimill.sinks import (
    read_dead_letters,
    read_metrics,
    read_predictions,
    write_ticks,
    write_ticks_csv,
)
from varimill.sources import read_daily, read_ticks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400_000
START = 19_700 * DAY


def down_on_odd_days(requests):
    days = np.asarray(requests.column("ts")) // DAY
    status = np.where(days % 2 == 1, "error", "ok").astype(object)
    return Outcome(status, np.full(len(days), np.nan), days * 1.0)


def back_up(requests):
    n = requests.num_rows
    return Outcome(np.full(n, "ok", dtype=object), np.full(n, np.nan), np.full(n, 7.0))


def keys(df):
    return {(r.symbol, r.ts) for r in df.select("symbol", "ts").collect()}


def test_files_to_predictions_to_replay(spark, ticks_of, tmp_path):
    rng = random.Random(4)
    rows = [
        (s, START + d * DAY + i * 1000, 1 + rng.random())
        for s in "ab"
        for d in range(26)
        for i in range(6)
    ]
    path = {k: str(tmp_path / k) for k in ("csv", "ticks", "store", "replayed", "cp", "metrics")}
    write_ticks_csv(ticks_of(rows), path["csv"])
    ingest_job(spark, path["csv"], path["ticks"], PipelineConfig(last_n=25))
    ticks = read_ticks(spark, path["ticks"])
    assert ticks.count() == 2 * 25 * 6

    run = dict(scorer=down_on_odd_days, backoff_ms=0, breaker_threshold=None)
    for _ in range(2):  # the second run replaces the first
        forecast_job(spark, path["ticks"], path["store"], 3, metrics=path["metrics"], **run)
    want = keys(forecasts(ticks))
    good, dead = (f(spark, path["store"]) for f in (read_predictions, read_dead_letters))
    assert len(want) == 8 and keys(good) | keys(dead) == want and not keys(good) & keys(dead)
    assert good.count() == 4 == dead.count()
    assert [r.total_ticks for r in read_metrics(spark, path["metrics"]).collect()] == [300, 300]

    for _ in range(2):  # nothing is left for the second replay
        replay_job(spark, path["store"], path["replayed"], path["cp"], back_up)
    again = read_predictions(spark, path["replayed"])
    assert keys(again) == keys(dead) and again.count() == 4
    assert {r.lstm_pred for r in again.collect()} == {7.0}

    forecast_job(spark, path["ticks"], path["store"], 4, config=PipelineConfig(ml_enabled=False))
    stored = spark.read.parquet(path["store"]).where("batch_id = 4")
    assert stored.agg(F.sum("har_pred")).first()[0] == 0.0 and stored.count() == 8


def test_sweep_goes_on_after_a_failed_run(spark):
    def run(inputs):
        if inputs == 2:
            raise RuntimeError("no such thing")
        return 100 * inputs

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sweep(spark, run, (1, 2), (3, 5)).collect()
    assert [(r.input_partitions, r.parallelism, r.total_ticks) for r in rows] == [
        (1, 3, 100), (1, 5, 100), (2, 3, 0), (2, 5, 0)
    ]
    assert rows[0].error is None and "no such thing" in rows[2].error
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_session_settings(spark):
    spark.conf.set("spark.varimill.ml_enabled", "false")
    spark.conf.set("spark.varimill.test_start", "2024-01-25")
    spark.conf.set("spark.varimill.last_n", "9")
    try:
        config = PipelineConfig.from_session(spark)
    finally:
        for name in ("ml_enabled", "test_start", "last_n"):
            spark.conf.unset(f"spark.varimill.{name}")
    assert (config.ml_enabled, str(config.test_start), config.last_n) == (False, "2024-01-25", 9)
    assert PipelineConfig.from_session(spark) == PipelineConfig()


def test_shared_folder_is_the_one_the_session_names():
    from types import SimpleNamespace

    from varimill.workspace import run_dir, shared_dir

    def session(master="local[4]", set_dir=None, **settings):
        settings = {k.replace("_", "."): v for k, v in settings.items()}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_dir)
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=context)

    named = session(spark_checkpoint_dir="hdfs://n/s/")
    assert run_dir(named, "x").startswith("hdfs://n/s/x-")
    assert shared_dir(session("yarn", "hdfs://n/c")) == "hdfs://n/c"
    assert shared_dir(session()).endswith("/varimill")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))


def test_a_file_ingested_again_replaces_itself(spark, ticks_of, tmp_path):
    csv, table = str(tmp_path / "csv"), str(tmp_path / "ticks")
    # The last tick belongs to another day than its file.
    rows = [("a", START + d * DAY + i, 1.0 + i) for d in range(3) for i in range(2)] + [(" ", START, 3.0)]
    write_ticks_csv(ticks_of(rows), csv)
    for config in (PipelineConfig(), PipelineConfig(last_n=1), PipelineConfig()):
        ingest_job(spark, csv, table, config)
        assert read_ticks(spark, table).count() == len(rows)
    assert "" in {r.symbol for r in read_ticks(spark, table).collect()}


def test_replay_into_its_own_store_keeps_all_rows(spark, ticks_of, tmp_path):
    rng = random.Random(4)
    rows = [("a", START + d * DAY + i * 1000, 1 + rng.random()) for d in range(30) for i in range(6)]
    store, table = str(tmp_path / "store"), str(tmp_path / "ticks")
    write_ticks(ticks_of(rows), table)
    run = dict(scorer=down_on_odd_days, backoff_ms=0, breaker_threshold=None, config=PipelineConfig())
    forecast_job(spark, table, store, 0, **run)
    want = keys(read_predictions(spark, store)) | keys(read_dead_letters(spark, store))
    lost = keys(read_dead_letters(spark, store))
    assert len(want) == 9 and lost
    replay_job(spark, store, None, str(tmp_path / "cp1"), down_on_odd_days)
    assert keys(read_dead_letters(spark, store)) == lost, "what fails again stays a letter, once"
    for _ in range(2):
        replay_job(spark, store, None, str(tmp_path / "cp2"), back_up)
    assert keys(read_predictions(spark, store)) == want
    assert read_predictions(spark, store).count() == 9 and read_dead_letters(spark, store).count() == 0
    # Another run over the same ticks does not show a prediction twice.
    forecast_job(spark, table, store, 1, config=PipelineConfig(ml_enabled=False))
    assert read_predictions(spark, store).count() == 9


def test_defaults_are_the_fixed_values():
    c = PipelineConfig()
    assert (c.weekly, c.monthly, c.min_ticks, c.har) == (5, 22, 2, (0.1, 0.4, 0.3, 0.2))
    assert (c.max_attempts, c.backoff_ms, c.breaker_threshold, c.breaker_open_s) == (3, 100, 5, 30)
    assert pytest.approx(c.bar_width.total_seconds()) == 300


def test_daily_table_is_extended_without_reading_old_ticks(spark, ticks_of, tmp_path):
    rng = random.Random(8)
    rows = [("a", START + d * DAY + i * 1000, 1 + rng.random()) for d in range(28) for i in range(6)]
    table, daily, store = (str(tmp_path / d) for d in ("ticks", "daily", "store"))
    write_ticks(ticks_of(rows), table)
    config = PipelineConfig()
    daily_job(spark, table, daily, config=config)
    before = {r.ts: r.rv_daily for r in read_daily(spark, daily).collect()}
    late = day_text(START + 26 * DAY)
    daily_job(spark, table, daily, from_date=late, config=config)
    assert {r.ts: r.rv_daily for r in read_daily(spark, daily).collect()} == before and len(before) == 28
    daily_forecast_job(spark, daily, store, "all", config=config)
    assert keys(read_predictions(spark, store)) == keys(forecasts(ticks_of(rows)))
    daily_forecast_job(spark, daily, str(tmp_path / "new"), 0, from_date=late, config=config)
    assert len(keys(read_predictions(spark, str(tmp_path / "new")))) == 2
    plan = read_ticks(spark, table, from_date=late)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def day_text(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d")


def test_scoring_is_dealt_to_more_than_one_task(spark):
    from varimill.operators import score
    from varimill.schemas import REQUEST

    rows = [(f"s{i % 50}", i, 1.0, 1.0, 1.0, False, "p", None) for i in range(8800)]
    frame = spark.createDataFrame(rows, REQUEST).coalesce(1)
    scored = score(frame, back_up).select(F.spark_partition_id().alias("task"))
    assert scored.distinct().count() > 1
