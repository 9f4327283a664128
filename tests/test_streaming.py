import random

import pytest

from varimill.operators import model_requests
from varimill.plans import daily_variance
from varimill.schemas import DAILY_RV, REQUEST, TICK
from varimill.sinks import read_dead_letters, read_predictions
from varimill.sources import read_ticks
from varimill.streaming import (
    available_now,
    daily_rv_stream,
    latest_event_ms,
    request_stream,
    score_batches,
    send_flush,
    with_flush,
    write_batches,
)

DAY = 86_400_000
START = 19_700 * DAY


class Landing:
    """A directory that receives one file of ticks at a time, and its stream."""

    def __init__(self, spark, ticks_of, base, build, write=None):
        self.spark, self.ticks_of, self.base = spark, ticks_of, base
        self.path, self.flush_path = str(base / "ticks"), str(base / "flush")
        self.rows, self.seq = [], 0
        ticks_of([]).write.parquet(self.path)
        stream = spark.readStream.schema(TICK).parquet(self.path)
        self.result = build(with_flush(stream, self.flush_path))
        self.write = write or write_batches(str(base / "out"))

    def land(self, rows):
        rows = [(*r, r[2], 1.0, self.seq + i) for i, r in enumerate(rows)]
        self.seq += len(rows)
        self.rows += rows
        self.ticks_of(rows).coalesce(1).write.mode("append").parquet(self.path)
        return self.run()

    def run(self):
        return available_now(self.result, self.write, str(self.base / "checkpoint"), 2)

    def flush(self, query):
        send_flush(self.spark, self.flush_path, latest_event_ms(query))
        return self.run()

    def read(self, schema):
        return self.spark.read.schema(schema).parquet(str(self.base / "out")).select(*schema.names)


def day_of_ticks(rng, day, n=40, symbols="ab"):
    return [
        (rng.choice(symbols), START + day * DAY + rng.randrange(3) * 300_000 + rng.randrange(9000), 1 + rng.random())
        for _ in range(n)
    ]


def test_days_arriving_one_by_one_equal_the_batch(spark, ticks_of, tmp_path):
    landing = Landing(spark, ticks_of, tmp_path, daily_rv_stream)
    rng = random.Random(5)
    for day in range(3):
        query = landing.land(day_of_ticks(rng, day))
    before = landing.read(DAILY_RV).count()
    landing.flush(query)
    got = {(r.symbol, r.ts): r.rv_daily for r in landing.read(DAILY_RV).collect()}
    want = {(r.symbol, r.ts): r.rv_daily for r in daily_variance(ticks_of(landing.rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert before < len(want), "the last day stays open until the flush"


def test_late_ticks_are_dropped_and_counted_ticks_are_all(spark, ticks_of, tmp_path):
    landing = Landing(spark, ticks_of, tmp_path, daily_rv_stream)
    first = [("a", START + i, 1.0 + i) for i in range(4)]
    landing.land(first)
    # Moves the watermark past the first bar; the 3 seconds are not enough.
    landing.land([("a", START + 400_000, 2.0), ("a", START + 400_001, 3.0)])
    query = landing.land([("a", START + 5, 99.0), ("a", START + 400_002, 4.0)])
    progress = query.recentProgress
    dropped = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    assert dropped == 1
    assert sum(p["observedMetrics"]["ticks"]["ticks"] for p in progress if p["observedMetrics"]) == 2
    landing.flush(query)
    kept = [r for r in landing.rows if r[2] != 99.0]
    want = daily_variance(ticks_of(kept)).first()
    got = landing.read(DAILY_RV).collect()
    assert [(r.ts, r.rv_daily) for r in got] == [(want.ts, pytest.approx(want.rv_daily))]


def test_invalid_future_tick_does_not_move_time(spark, ticks_of, tmp_path):
    landing = Landing(spark, ticks_of, tmp_path, daily_rv_stream)
    landing.land([("a", START, 1.0), ("a", START + 9 * DAY, -1.0)])
    query = landing.land([("a", START + 1, 2.0)])
    landing.flush(query)
    assert [r.ts for r in landing.read(DAILY_RV).collect()] == [START + DAY]


def test_scored_stream_equals_batch_and_survives_restarts(spark, ticks_of, tmp_path):
    root = str(tmp_path / "store")
    test_start = "2023-12-31"  # day 19722
    landing = Landing(
        spark,
        ticks_of,
        tmp_path,
        lambda t: request_stream(daily_rv_stream(t), test_start),
        write=lambda batch, i: (
            write_batches(str(tmp_path / "out"))(batch.drop("status"), i),
            score_batches(root)(batch, i),
        ),
    )
    rng = random.Random(9)
    for days in (range(20), range(20, 24), range(24, 26)):
        query = landing.land([t for d in days for t in day_of_ticks(rng, d, n=24)])
    landing.flush(query)
    batch = model_requests(daily_variance(ticks_of(landing.rows)), test_start)
    want = {(r.symbol, r.ts): r for r in batch.collect()}
    got = {(r.symbol, r.ts): r for r in landing.read(REQUEST).collect()}
    assert got.keys() == want.keys() and len(want) >= 4
    for key, r in want.items():
        assert got[key].payload == r.payload and got[key].is_first == r.is_first
        for a, b in zip(got[key].sequence, r.sequence, strict=True):
            assert a == pytest.approx(b, abs=1.1e-10)
    assert {(r.symbol, r.ts) for r in read_predictions(spark, root).collect()} == want.keys()
    assert read_dead_letters(spark, root).count() == 0


def test_tick_table_streams(spark, ticks_of, tmp_path):
    from varimill.sinks import write_ticks

    path = str(tmp_path / "table")
    write_ticks(ticks_of([("a", START + 1, 1.0), ("a", START + DAY, 2.0)]), path)
    stream = read_ticks(spark, path, streaming=True, from_date="2023-12-10")
    available_now(stream, write_batches(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.ts, r.bid) for r in got] == [(START + DAY, 2.0)]


def test_a_stream_goes_on_after_a_flush(spark, ticks_of, tmp_path):
    landing = Landing(spark, ticks_of, tmp_path, daily_rv_stream)
    rng = random.Random(7)
    query = landing.land(day_of_ticks(rng, 0))
    for day in (1, 2, 5):
        query = landing.flush(query)
        query = landing.flush(query)  # sent twice: the same tick again
        query = landing.land(day_of_ticks(rng, day) + [("a", START + day * DAY, 1.5), ("a", START + day * DAY + 1, 1.6)])
    landing.flush(query)
    got = {(r.symbol, r.ts): r.rv_daily for r in landing.read(DAILY_RV).collect()}
    want = {(r.symbol, r.ts): r.rv_daily for r in daily_variance(ticks_of(landing.rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert {s for s, _ in got} == {"a", "b"}


@pytest.mark.parametrize(("known", "gate"), [(25, None), (30, None), (10, None), (24, "2023-12-31")])
def test_a_stream_goes_on_where_the_daily_table_ends(spark, daily_of, tmp_path, known, gate):
    """Days of before leave their state, but no request; the others are the batch's."""
    rng = random.Random(known)
    rows = [(s, START + (i + 1) * DAY, rng.random()) for i in range(40) for s in "ab"]
    rows += [("new", START + (i + 1) * DAY, rng.random()) for i in range(30, 40)]
    before = [r for r in rows if r[1] <= START + known * DAY]
    landing = str(tmp_path / "daily")
    daily_of([r for r in rows if r not in before]).coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(DAILY_RV).parquet(landing)
    made = request_stream(stream, gate, history=daily_of(before))
    available_now(made, write_batches(str(tmp_path / "out")), str(tmp_path / "checkpoint"), 2)
    got = spark.read.schema(REQUEST).parquet(str(tmp_path / "out")).select(*REQUEST.names)
    want = model_requests(daily_of(rows), gate).where(f"ts > {START + known * DAY}").select(*REQUEST.names)

    def rounded(df):
        return sorted(
            (r.symbol, r.ts, r.is_first, r.payload, [[round(x, 8) for x in y] for y in r.sequence]) for r in df.collect()
        )

    assert rounded(got) == rounded(want) and got.count() > 0
