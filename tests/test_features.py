import json
import math
import random

import pytest
import simulation
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from varimill.operators import (
    first_requests,
    gate,
    model_requests,
    model_sequences,
    request_payloads,
    rv_features,
)

DAY = 86_400_000
INF, NAN = math.inf, math.nan


def series(symbol, values, start=20_000, skip=()):
    """Daily rows; ``skip`` leaves calendar days without a row."""
    out, day = [], start
    for v in values:
        while day in skip:
            day += 1
        out.append((symbol, day * DAY, v))
        day += 1
    return out


def by_key(df):
    return {(r.symbol, r.ts): r for r in df.collect()}


def test_features_average_rows_not_calendar_days(daily_of):
    values = [float(i) for i in range(1, 31)]
    rows = series("a", values, skip={20_005, 20_006, 20_020}) + series("b", values[:21])
    got = by_key(rv_features(daily_of(rows)))
    assert len(got) == 30 - 21 and {s for s, _ in got} == {"a"}
    last = got["a", rows[29][1]]
    assert (last.rv_daily, last.rv_weekly, last.rv_monthly) == (30.0, 28.0, 19.5)


@pytest.mark.parametrize("offset, kept", [(-1, 9), (0, 8), (1, 7)])
def test_gate_excludes_the_day_ending_at_its_start(daily_of, offset, kept):
    from datetime import date, timedelta

    rows = series("a", [1.0] * 30)
    first_full = date(1970, 1, 1) + timedelta(days=20_000 + 21 + offset)
    daily = daily_of(rows)
    assert gate(rv_features(daily), first_full).count() == kept
    assert request_payloads(daily, first_full).count() == kept
    assert gate(rv_features(daily), None).count() == 9


def test_bad_day_leaves_no_row_but_stays_in_the_frames(daily_of):
    values = [1.0] * 24 + [INF] + [1.0] * 30
    rows = series("a", values)
    got = by_key(rv_features(daily_of(rows)))
    assert ("a", rows[24][1]) not in got
    assert got["a", rows[28][1]].rv_weekly == INF and got["a", rows[29][1]].rv_weekly == 1.0
    assert got["a", rows[45][1]].rv_monthly == INF and got["a", rows[46][1]].rv_monthly == 1.0


def test_first_request_per_symbol(daily_of):
    rows = series("a", [1.0] * 40) + series("b", [2.0] * 30, start=20_100)
    got = {r.symbol: r.ts for r in first_requests(daily_of(rows), "2024-11-03").collect()}
    # 2024-11-03 is day 20030 of the epoch.
    assert got == {"a": 20_031 * DAY, "b": 20_121 * DAY}


def assert_requests_match(daily_of, rows, test_start=None, gate_ms=None):
    got = by_key(model_requests(daily_of(rows), test_start))
    want = {}
    for symbol in {r[0] for r in rows}:
        days = [(ts, v) for s, ts, v in rows if s == symbol]
        for ts, *features, first, sequence in simulation.requests(days, gate_ms):
            want[symbol, ts] = (features, first, sequence)
    assert got.keys() == want.keys()
    for key, (features, first, sequence) in want.items():
        r = got[key]
        assert [r.rv_daily, r.rv_weekly, r.rv_monthly] == pytest.approx(features, nan_ok=True)
        assert r.is_first == first
        assert (r.sequence is None) == (sequence is None)
        for a, b in zip(r.sequence or [], sequence or [], strict=True):
            assert a == pytest.approx(b, abs=1.1e-10)


@pytest.mark.parametrize("gate_day", [None, 0, 21, 22, 30])
def test_sequences_equal_the_two_sided_simulation(daily_of, gate_day):
    from datetime import date, timedelta

    rng = random.Random(gate_day)
    rows = series("a", [rng.random() for _ in range(60)], skip={20_003, 20_031})
    rows += series("b", [rng.random() for _ in range(25)])
    start = None if gate_day is None else date(1970, 1, 1) + timedelta(days=20_000 + gate_day)
    gate_ms = None if gate_day is None else (20_000 + gate_day) * DAY
    assert_requests_match(daily_of, rows, start, gate_ms)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(st.floats(0, 10), st.floats(0, 10), st.sampled_from([INF, NAN, 0.5])),
        min_size=20,
        max_size=80,
    )
)
def test_sequences_with_non_finite_days(daily_of, values):
    assert_requests_match(daily_of, series("a", values))


def test_payload_text(daily_of):
    rows = series('q"\\', [i / 7 for i in range(1, 25)])
    got = request_payloads(daily_of(rows)).orderBy("ts").collect()
    first = json.loads(got[0].payload)
    assert first["symbol"] == 'q"\\'
    assert len(first["history"]) == 22
    assert first["history"][1] == [0.2857142857, 0.2142857143, 0.2142857143]
    assert first["history"][6] == [1.0, 0.7142857143, 0.5714285714]
    assert got[0].payload.endswith("]]}")
    assert [r.is_first for r in got] == [True, False, False]
    assert "history" not in json.loads(got[1].payload)
    assert '"rv_daily":3.2857142857,"rv_weekly":3.0000000000,' in got[1].payload


def test_accepted_sequences_are_full(daily_of):
    rows = series("a", [0.1 * i for i in range(50)])
    got = model_sequences(daily_of(rows)).collect()
    assert len(got) == 29 and {len(r.sequence) for r in got} == {22}
