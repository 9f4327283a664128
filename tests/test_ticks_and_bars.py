import math
import random
from datetime import timedelta

import pytest
import simulation
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from varimill.operators import (
    daily_rv,
    invalid_reasons,
    log_return_bars,
    tick_counts,
    valid_ticks,
    with_tick_counter,
)
from varimill.plans import daily_variance

NAN, INF = math.nan, math.inf
DAY = 86_400_000
MIDNIGHT = 19_724 * DAY
WIDTH = 300_000

EDGES = [
    (("a", 1, 1.0, 1.0, 0.0), []),
    (("a", 0, 1.0, 1.0, 0.0), ["ts"]),
    (("a", 1, 0.0, 1.0, 0.0), ["bid"]),
    (("a", 1, -1.0, 1.0, 0.0), ["bid"]),
    (("a", 1, 2.0, 1.0, 0.0), ["crossed"]),
    (("a", 1, 1.0, 1.0, -1.0), ["volume"]),
    (("a", 1, NAN, 1.0, 0.0), ["bid", "crossed"]),
    (("a", 1, 1.0, NAN, 0.0), ["ask", "crossed"]),
    (("a", 1, 1.0, 1.0, NAN), ["volume"]),
    (("a", 1, 1.0, 0.0, 0.0), ["ask", "crossed"]),
    (("a", 1, INF, INF, INF), []),
    (("a", 1, 1.0, INF, 0.0), []),
    (("a", 0, -1.0, -2.0, -1.0), ["ts", "bid", "ask", "crossed", "volume"]),
    (("a", 1, None, 1.0, 0.0), ["bid", "crossed"]),
    (("a", None, 1.0, 1.0, 0.0), ["ts"]),
]


def test_validity_edges(ticks_of):
    df = ticks_of([e for e, _ in EDGES])
    reasons = {r.seq: r.reasons for r in invalid_reasons(df).collect()}
    assert reasons == {i: why for i, (_, why) in enumerate(EDGES) if why}
    kept = {r.seq for r in valid_ticks(df).collect()}
    assert kept == {i for i, (_, why) in enumerate(EDGES) if not why}


def test_counter_counts_invalid_ticks_too(ticks_of):
    seen = Observation("ticks")
    kept = valid_ticks(with_tick_counter(ticks_of([e for e, _ in EDGES]), seen)).count()
    assert (seen.get["ticks"], kept) == (len(EDGES), 3)
    assert tuple(tick_counts(ticks_of([e for e, _ in EDGES])).first()) == (len(EDGES), 3)


def bars_of(df, **kw):
    return {
        (r.symbol, r.ts): (r.log_return, r.n_ticks) for r in log_return_bars(df, **kw).collect()
    }


def test_bar_edges(ticks_of):
    df = ticks_of(
        [
            ("a", MIDNIGHT, 1.0),
            ("a", MIDNIGHT + WIDTH - 1, 2.0),
            ("a", MIDNIGHT + WIDTH, 3.0),  # next bar, alone: no row
            ("b", MIDNIGHT, 5.0),  # a single tick: no row
        ]
    )
    assert bars_of(df) == {("a", MIDNIGHT + WIDTH): (pytest.approx(math.log(2)), 2)}
    assert len(bars_of(df, min_ticks=1)) == 3


def test_equal_times_go_by_arrival(ticks_of):
    df = ticks_of(
        [
            ("a", MIDNIGHT, 1.0, 1.0, 1.0, 7),
            ("a", MIDNIGHT, 2.0, 2.0, 1.0, 5),
            ("a", MIDNIGHT, 4.0, 4.0, 1.0, 6),
        ]
    )
    assert bars_of(df) == {("a", MIDNIGHT + WIDTH): (pytest.approx(math.log(1 / 2)), 3)}


def test_last_bar_of_the_day_stays_in_its_day(ticks_of):
    df = ticks_of([("a", MIDNIGHT - 2, 1.0), ("a", MIDNIGHT - 1, math.e)])
    rows = daily_rv(log_return_bars(df)).collect()
    assert [(r.symbol, r.ts) for r in rows] == [("a", MIDNIGHT)]
    assert rows[0].rv_daily == pytest.approx(1.0)


def test_sequence_number_too_large_stops_the_job(ticks_of):
    df = ticks_of([("a", MIDNIGHT, 1.0, 1.0, 1.0, 1 << 60)])
    with pytest.raises(PySparkException, match="seq outside"):
        log_return_bars(df).collect()


def test_infinite_bids_pass_and_make_non_finite_variance(ticks_of):
    df = ticks_of([("a", MIDNIGHT, 1.0), ("a", MIDNIGHT + 1, INF)])
    assert daily_variance(df).first().rv_daily == INF


def tick_lists():
    tick = st.tuples(
        st.sampled_from("abc"),
        st.integers(MIDNIGHT - WIDTH, MIDNIGHT + WIDTH),
        st.floats(0.01, 1e6),
    )
    return st.lists(tick, min_size=1, max_size=60)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(rows=tick_lists(), seed=st.integers(0, 99), partitions=st.integers(1, 7))
def test_bars_depend_on_neither_order_nor_partitions(ticks_of, rows, seed, partitions):
    # Times crowd onto few values, so that ties are common.
    rows = [(s, ts - ts % 60_000, bid, bid, 1.0, i) for i, (s, ts, bid) in enumerate(rows)]
    shuffled = random.Random(seed).sample(rows, len(rows))
    got = bars_of(ticks_of(shuffled).repartition(partitions))
    want = simulation.bars([(s, ts, bid, i) for s, ts, bid, _, _, i in rows], WIDTH)
    assert got == {k: (pytest.approx(r), n) for k, (r, n) in want.items()}


def test_hot_symbol_matches_simulation(ticks_of):
    rng = random.Random(1)
    rows = [
        ("hot" if rng.random() < 0.4 else f"s{rng.randrange(50)}",
         MIDNIGHT + rng.randrange(3 * DAY), 1 + rng.random())
        for _ in range(6000)
    ]
    width = timedelta(hours=2)
    df = ticks_of(rows)
    got = {(r.symbol, r.ts): r.rv_daily for r in daily_rv(log_return_bars(df, width)).collect()}
    bars = simulation.bars([(*r, i) for i, r in enumerate(rows)], 7_200_000)
    assert got == {k: pytest.approx(v) for k, v in simulation.daily(bars).items()}


def test_stored_bars_need_no_shuffle(spark, ticks_of, tmp_path):
    from varimill.operators import rv_features
    from varimill.sinks import write_bars_bucketed

    rng = random.Random(2)
    ticks = ticks_of(
        [
            (rng.choice("abc"), MIDNIGHT + rng.randrange(24) * DAY + rng.randrange(9 * 10**6), 1 + rng.random())
            for _ in range(9000)
        ]
    )
    write_bars_bucketed(log_return_bars(ticks), "stored_bars", 4, path=str(tmp_path / "t"))
    try:
        bars = spark.table("stored_bars")
        features = rv_features(daily_rv(bars))
        assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()
        assert features.count() == 9
        got = {(r.symbol, r.ts): r.rv_daily for r in daily_rv(bars).collect()}
    finally:
        spark.sql("DROP TABLE stored_bars")
    want = {(r.symbol, r.ts): r.rv_daily for r in daily_variance(ticks).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
