import math

import pytest
from pyspark.errors import PySparkException

from varimill.operators import score
from varimill.schemas import PREDICTION, PREDICTION_ROW, REQUEST, RUN_METRICS
from varimill.sinks import (
    append_metrics,
    prediction_rows,
    read_dead_letters,
    read_metrics,
    read_predictions,
    write_scored,
    write_ticks,
)
from varimill.sources import read_ticks

DAY = 86_400_000


def scored(spark, values, start=0):
    rows = [("a", start + i, v, 1.0, 1.0, False, f"p{i}", None) for i, v in enumerate(values)]
    return score(spark.createDataFrame(rows, REQUEST))


def test_outcomes_are_stored_apart_and_a_repeated_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "store")
    write_scored(scored(spark, [1.0, math.nan, 2.0]), 7, root, partitions=2)
    write_scored(scored(spark, [3.0, math.inf], start=100), 8, root)
    assert {r.ts for r in read_predictions(spark, root).collect()} == {0, 2, 100}
    assert {(r.ts, r.payload) for r in read_dead_letters(spark, root).collect()} == {
        (1, "p1"),
        (101, "p1"),
    }
    # The second attempt of batch 7 has no dead letters: none must be left over.
    write_scored(scored(spark, [1.0, 5.0, 2.0]), 7, root)
    assert {r.ts for r in read_predictions(spark, root).collect()} == {0, 1, 2, 100}
    assert {r.ts for r in read_dead_letters(spark, root).collect()} == {101}


def test_empty_batch_reads_as_no_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    write_scored(scored(spark, []), 0, root)
    assert read_predictions(spark, root).count() == read_dead_letters(spark, root).count() == 0


def test_rebalanced_days_hold_the_same_ticks(spark, ticks_of, tmp_path):
    rows = [("a", (19000 + i % 3) * DAY + i + 1, 1.0) for i in range(300)]
    path = str(tmp_path / "ticks")
    write_ticks(ticks_of(rows).repartition(7), path, rebalance=True)
    df = read_ticks(spark, path)
    assert {(r.ts, r.day) for r in df.select("ts", "day").collect()} == {
        (ts, ("2022-01-08", "2022-01-09", "2022-01-10")[ts // DAY - 19000]) for _, ts, _ in rows
    }
    assert len(df.inputFiles()) == 3


def test_prediction_rows_have_the_table_layout(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0, None, 0.5, 0.7)], PREDICTION)
    rows = prediction_rows(df)
    assert rows.columns == PREDICTION_ROW.names
    assert rows.first().id == prediction_rows(df).first().id
    assert rows.first().mamba_pred is None


@pytest.mark.parametrize("name", ["symbol", "ts", "rv_weekly", "har_pred"])
def test_null_in_a_required_column_stops_the_write(spark, name):
    nullable = PREDICTION.fromJson(PREDICTION.jsonValue())
    for f in nullable:
        f.nullable = True
    row = dict(symbol="a", ts=1, rv_daily=1.0, rv_weekly=2.0, rv_monthly=3.0, har_pred=0.7)
    values = [None if n == name else row.get(n) for n in PREDICTION.names]
    with pytest.raises(PySparkException, match=f"null in required column {name}"):
        prediction_rows(spark.createDataFrame([tuple(values)], nullable)).collect()


def test_symbol_too_long_for_the_table(spark):
    df = spark.createDataFrame([("a" * 21, 1, 1.0, 2.0, 3.0, None, None, 0.7)], PREDICTION)
    with pytest.raises(PySparkException, match="symbol longer than 20"):
        prediction_rows(df).collect()


def test_metrics_append_and_read_back(spark, tmp_path):
    path = str(tmp_path / "metrics")
    names = RUN_METRICS.names[:-1]
    run = ("2024-01-01T00:00:00", 8, 16, 60000, True, 3000, 2000)
    still = ("2024-01-01T00:00:01", 8, 16, 60000, False, 5, 0)
    for row in (run, still):
        append_metrics(spark.createDataFrame([row], names), path)
    got = [tuple(r) for r in read_metrics(spark, path).orderBy("run_timestamp").collect()]
    assert got == [(*run, 1500.0), (*still, 0.0)]


def test_metrics_with_a_decimal_comma(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        ",".join(RUN_METRICS.names) + "\n2024-01-01T00:00:00,2,4,60000,true,100,10,10000,25\n"
    )
    row = read_metrics(spark, str(tmp_path)).first()
    assert row.throughput_ticks_per_sec == 10000.25 and row.elapsed_ms == 10


def test_tick_table_prunes_days(spark, ticks_of, tmp_path):
    path = str(tmp_path / "ticks")
    write_ticks(ticks_of([("a", d * DAY + 1, 1.0) for d in range(19000, 19004)]), path)
    df = read_ticks(spark, path, from_date="2022-01-10")
    assert df.count() == 2
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()


def test_what_the_table_cannot_hold_becomes_a_letter(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("a" * 21, 1, 1.0, 1.0, 1.0, False, "p", None), ("b", None, 1.0, 1.0, 1.0, False, "q", None)]
    write_scored(score(spark.createDataFrame(rows, REQUEST)), 0, root)
    assert read_predictions(spark, root).count() == 0
    assert {r.reason for r in read_dead_letters(spark, root).collect()} == {"invalid"}
