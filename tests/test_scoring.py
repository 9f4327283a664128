import math
import sys
import threading
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from varimill.operators import (
    LstmModel,
    Outcome,
    SequenceScorer,
    bypass,
    har,
    replay,
    score,
    split_scored,
    validate_requests,
)
from varimill.operators.scoring import ERROR, INVALID, OK, _Breaker, _Caller
from varimill.schemas import DEAD_LETTER, REQUEST

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAN, INF = math.nan, math.inf
MATRIX = [[float(i), 0.5, 0.25] for i in range(22)]


def request(ts, d=1.0, w=2.0, m=3.0, sequence=MATRIX, symbol="a"):
    return (symbol, ts, d, w, m, False, f"payload {ts}", sequence)


@pytest.fixture
def requests_of(spark):
    return lambda rows: spark.createDataFrame(rows, REQUEST).coalesce(1)


@dataclass
class Scripted:
    """Answers each request by its ``ts``: one status per attempt."""

    script: dict
    default: str = OK

    def __post_init__(self):
        self.calls = []

    def __call__(self, requests: pa.RecordBatch) -> Outcome:
        stamps = requests.column("ts").to_pylist()
        status = []
        for ts in stamps:
            seen = sum(ts in call for call in self.calls)
            steps = self.script.get(ts, [self.default])
            status.append(steps[min(seen, len(steps) - 1)])
        self.calls.append(stamps)
        if "raise" in status:
            raise RuntimeError("scorer down")
        n = len(stamps)
        return Outcome(np.array(status, dtype=object), np.full(n, NAN), np.arange(n) + 0.5)


class Clock:
    def __init__(self):
        self.now, self.sleeps = 0.0, []

    def sleep(self, seconds):
        self.sleeps.append(round(seconds, 3))
        self.now += seconds

    def __call__(self):
        return self.now


def call(scorer, stamps, clock=None, batches=1, **options):
    """Statuses and attempts of requests that reach one task, in order."""
    clock = clock or Clock()
    settings = dict(
        max_attempts=3,
        backoff_ms=100,
        breaker_threshold=5,
        breaker_open_s=30.0,
        capacity=1,
        is_ready=None,
        ready_poll_s=10.0,
        ready_timeout_s=60.0,
        sleep=clock.sleep,
        clock=clock,
    )
    caller = _Caller(scorer, **(settings | options))
    n = len(stamps)
    table = {
        "ts": pa.array(stamps, pa.int64()),
        "status": pa.array([OK] * n),
        "attempts": pa.array([0] * n, pa.int32()),
        "mamba_pred": pa.nulls(n, pa.float64()),
        "lstm_pred": pa.nulls(n, pa.float64()),
    }
    batch = pa.RecordBatch.from_pydict(table)
    size = math.ceil(n / batches)
    out = pa.Table.from_batches(caller(batch.slice(i, size) for i in range(0, n, size)))
    return list(zip(out["status"].to_pylist(), out["attempts"].to_pylist())), clock


def test_retries_pause_between_attempts_only():
    scorer = Scripted({1: [ERROR, ERROR, OK], 2: [ERROR], 3: ["raise"]})
    got, clock = call(scorer, [1, 2, 3])
    assert got == [(OK, 3), ("failed", 3), ("failed", 3)]
    assert clock.sleeps == [0.1, 0.2] * 3


def test_invalid_is_not_retried_and_leaves_the_breaker_alone():
    scorer = Scripted({i: [INVALID] for i in range(20)}, default=ERROR)
    got, clock = call(scorer, list(range(20)))
    assert got == [(INVALID, 1)] * 20 and clock.sleeps == []


def test_breaker_opens_after_five_exhausted_requests():
    got, _ = call(Scripted({}, default=ERROR), list(range(8)))
    assert got == [("failed", 3)] * 5 + [("blocked", 0)] * 3


def test_success_resets_the_breaker():
    script = {i: [ERROR] for i in range(9) if i != 4}
    got, _ = call(Scripted(script), list(range(9)))
    assert [s for s, _ in got] == ["failed"] * 4 + [OK] + ["failed"] * 4


def test_first_failure_after_the_pause_opens_again():
    clock = Clock()
    # Opening at request 5 blocks 6 and 7; after the pause one failure re-opens.
    breaker = _Breaker(5, 30.0, clock)
    seen = []
    for ts in range(9):
        if ts == 7:
            clock.now += 31.0
        if breaker.is_open():
            seen.append("blocked")
            continue
        seen.append("failed")
        breaker.record(False)
    assert seen == ["failed"] * 5 + ["blocked"] * 2 + ["failed", "blocked"]


def test_requests_of_one_call_are_retried_together():
    scorer = Scripted({2: [ERROR, OK], 3: [INVALID]})
    got, clock = call(scorer, [1, 2, 3, 4], capacity=None)
    assert got == [(OK, 1), (OK, 2), (INVALID, 1), (OK, 1)]
    assert scorer.calls == [[1, 2, 3, 4], [2]] and clock.sleeps == [0.1]


def test_wrong_answer_count_is_an_error():
    got, _ = call(lambda r: Outcome(np.array([OK] * 9), np.zeros(9), np.zeros(9)), [1])
    assert got == [("failed", 3)]


def test_readiness_is_awaited_once_per_task():
    answers = iter([False, False, True])
    got, clock = call(Scripted({}), [1, 2, 3, 4], batches=2, is_ready=lambda: next(answers))
    assert got == [(OK, 1)] * 4 and clock.sleeps == [10.0, 10.0]


def test_never_ready_leaves_dead_letters():
    scorer = Scripted({})
    got, _ = call(scorer, [1, 2], is_ready=lambda: False)
    assert got == [("failed", 0)] * 2 and scorer.calls == []


def test_har_uses_the_rounded_features(requests_of):
    row = har(requests_of([request(1, 0.00000000005, 0.00000000004, 1.0)])).first()
    assert row.har_pred == 0.1 + 0.4 * 1e-10 + 0.3 * 0.0 + 0.2 * 1.0
    row = har(requests_of([request(1)]), b=(1, 2, 3, 4), decimals=None).first()
    assert row.har_pred == 21.0


def test_validation(requests_of):
    rows = [request(0)]
    rows += [request(i + 1, **{k: v}) for i, (k, v) in enumerate((k, v) for k in "dwm" for v in (NAN, INF, -INF, None))]
    got = {r.ts: r.status for r in validate_requests(requests_of(rows)).collect()}
    assert got == {0: OK} | {i: INVALID for i in range(1, 13)}


def test_every_request_ends_on_one_side(requests_of):
    rows = [request(i, d=NAN if i % 5 == 0 else 1.0) for i in range(40)]
    script = {i: [ERROR] for i in range(3, 40, 7)} | {i: [INVALID] for i in range(2, 40, 7)}
    scored = score(requests_of(rows), Scripted(script), backoff_ms=0, breaker_threshold=None)
    good, dead = split_scored(scored)
    good, dead = {r.ts for r in good.collect()}, {r.ts: r for r in dead.collect()}
    assert good | dead.keys() == set(range(40)) and not good & dead.keys()
    assert dead[0].reason == INVALID and dead[3].reason == "failed"
    assert dead[3].payload == "payload 3" and dead[3].sequence == MATRIX


def test_no_scorer_needs_no_python(requests_of):
    scored = score(requests_of([request(1), request(2, d=INF)]))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    good, dead = split_scored(scored)
    row = good.first()
    assert (row.mamba_pred, row.lstm_pred, row.har_pred) == (None, None, pytest.approx(1.7))
    assert dead.first().ts == 2


def test_bypass(requests_of):
    row = bypass(requests_of([request(1)])).first()
    assert (row.rv_monthly, row.mamba_pred, row.lstm_pred, row.har_pred) == (3.0, None, None, 0.0)


def naive_lstm(model, steps):
    hidden = model.w_hh.shape[1]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    h, c = [0.0] * hidden, [0.0] * hidden
    for x in steps:
        z = [
            sum(w * v for w, v in zip(model.w_ih[r], x))
            + sum(w * v for w, v in zip(model.w_hh[r], h))
            + model.b_ih[r]
            + model.b_hh[r]
            for r in range(4 * hidden)
        ]
        i, f, g, o = (z[k * hidden : (k + 1) * hidden] for k in range(4))
        c = [sigmoid(a) * p + sigmoid(b) * math.tanh(q) for a, p, b, q in zip(f, c, i, g)]
        h = [sigmoid(a) * math.tanh(p) for a, p in zip(o, c)]
    return sum(w * v for w, v in zip(model.head_w[0], h)) + model.head_b[0]


def test_lstm_equals_a_naive_forward_pass():
    model = LstmModel.from_seed(3)
    x = np.random.default_rng(0).normal(size=(4, 22, 3)).astype(np.float32)
    assert model(x) == pytest.approx([naive_lstm(model, s) for s in x], abs=1e-5)


def test_lstm_weights_from_file(tmp_path):
    model = LstmModel.from_seed(3)
    path = str(tmp_path / "weights.npz")
    np.savez(path, **vars(model))
    x = np.ones((2, 22, 3), np.float32)
    assert (LstmModel.from_npz(path)(x) == model(x)).all()


def test_sequence_scorer_on_spark(requests_of):
    model = LstmModel.from_seed(3)
    longer = [[9.0, 9.0, 9.0], *MATRIX]
    rows = [
        request(1),
        request(2, sequence=MATRIX[:21]),
        request(3, sequence=None),
        request(4, sequence=longer),
    ]
    scorer = SequenceScorer(lstm=model)
    got = {r.ts: r for r in score(requests_of(rows), scorer).collect()}
    want = float(model(np.array([MATRIX]))[0])
    assert got[1].lstm_pred == pytest.approx(want) and got[4].lstm_pred == pytest.approx(want)
    assert got[2].lstm_pred is None and got[3].lstm_pred is None
    assert {r.status for r in got.values()} == {OK}
    assert {r.mamba_pred for r in got.values()} == {None}
    both = score(requests_of(rows[:1]), SequenceScorer(mamba=model)).first()
    assert both.mamba_pred == pytest.approx(want) and both.lstm_pred is None


def payload(d="1.5", w="2.5", m="3.5", rest=""):
    return f'{{"symbol":"a","rv_daily":{d},"rv_weekly":{w},"rv_monthly":{m}{rest}}}'


@pytest.fixture
def letters_of(spark):
    def make(rows):
        return spark.createDataFrame(
            [("a", ts, text, sequence, "failed") for ts, text, sequence in rows], DEAD_LETTER
        ).coalesce(1)

    return make


def test_replay_reads_the_payload(letters_of):
    history = ',"history":[[1.0,2.0,3.0],[4.0,5.0,6.0]]'
    letters = letters_of(
        [
            (1, payload(), MATRIX),
            (2, payload(rest=history), None),
            (3, payload(d="NaN"), None),
            (4, "not json", None),
            (5, '{"symbol":"a","rv_daily":1.0}', None),
            (6, payload(d='{"x":1}'), None),
        ]
    )
    got = {r.ts: r for r in replay(letters, Scripted({1: [ERROR, OK]})).collect()}
    assert (got[1].status, got[1].attempts, got[1].rv_weekly) == (OK, 2, 2.5)
    assert got[1].sequence == MATRIX and got[1].har_pred == pytest.approx(0.1 + 0.6 + 0.75 + 0.7)
    assert got[2].sequence == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    assert [got[i].status for i in (3, 4, 5, 6)] == [INVALID] * 4
    assert got[1].replayed_at is not None


def test_failed_replay_stays_a_dead_letter(letters_of):
    letters = letters_of([(1, payload(), None)])
    _, dead = split_scored(replay(letters, Scripted({}, default=ERROR)))
    row = dead.first()
    assert (row.ts, row.reason, row.payload) == (1, "failed", payload())


def test_replay_time_can_be_the_processing_time(letters_of):
    row = replay(letters_of([(1, payload(), None)]), ts_mode="processing").first()
    assert row.ts == int(row.replayed_at.timestamp() * 1000) or row.ts > 1_600_000_000_000


@dataclass
class Timed:
    """A service on its own clock: seconds per attempt, by request."""

    seconds: dict
    now: float = 0.0

    def clock(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds

    def __call__(self, requests):
        for symbol in requests.column("symbol").to_pylist():
            self.now += self.seconds[symbol].pop(0)
        n = requests.num_rows
        return Outcome(np.full(n, OK, dtype=object), np.full(n, np.nan), np.zeros(n))


def _timed(spark, seconds, **options):
    rows = [(s, 1, 1.0, 1.0, 1.0, False, "p", None) for s in seconds]
    service = Timed({s: list(v) for s, v in seconds.items()})
    options = {"capacity": 1, "partitions": 1, "breaker_threshold": None, "call_timeout_s": 10.0, "total_timeout_s": 30.0} | options
    made = score(spark.createDataFrame(rows, REQUEST), service, clock=service.clock, sleep=service.sleep, **options)
    return {r.symbol: (r.status, r.attempts, r.error) for r in made.collect()}


def test_calls_and_requests_have_their_time(spark):
    got = _timed(
        spark,
        {"quick": [4], "edge": [10], "again": [11, 1], "slow": [12, 12, 12], "hung": [31], "late": [9.9, 9], "failed": [11, 1.0]},
    )
    assert got["quick"] == ("ok", 1, None) and got["edge"] == ("ok", 1, None)
    assert got["again"] == ("ok", 2, None) and got["late"] == ("ok", 1, None)
    assert got["slow"] == ("timeout", 3, "no answer within 5.7 s")
    assert got["hung"] == ("timeout", 1, "no answer within 10 s")
    # Without an end for all attempts, three slow ones are a failure.
    assert _timed(spark, {"slow": [12, 12, 12]}, total_timeout_s=None)["slow"][:2] == ("failed", 3)


def test_time_outs_open_the_breaker(spark):
    seconds = {f"s{i}": [31] for i in range(8)}
    got = _timed(spark, seconds, breaker_threshold=5, breaker_open_s=1000.0)
    assert sorted(v[0] for v in got.values()) == ["blocked"] * 3 + ["timeout"] * 5


class Hangs:
    """Never answers; the task must go on without it."""

    def __call__(self, requests):
        threading.Event().wait(60)


def test_a_call_that_hangs_is_left_behind(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, False, "p", None)], REQUEST)
    start = time.monotonic()
    row = score(rows, Hangs(), max_attempts=2, backoff_ms=0, call_timeout_s=0.2, partitions=1).first()
    assert (row.status, row.attempts) == ("failed", 2) and time.monotonic() - start < 30


class Meeting:
    """Answers once four calls are in it at a time."""

    def __init__(self):
        self.parties = 4

    def __call__(self, requests):
        barrier = sys.modules.setdefault("_test_barrier", threading.Barrier(self.parties))
        barrier.wait(30)
        n = requests.num_rows
        return Outcome(np.full(n, OK, dtype=object), np.full(n, np.nan), np.zeros(n))


def test_calls_are_in_flight_together(spark):
    rows = [(f"s{i}", 1, 1.0, 1.0, 1.0, False, "p", None) for i in range(8)]
    made = score(spark.createDataFrame(rows, REQUEST), Meeting(), capacity=1, partitions=1, in_flight=4, max_attempts=1)
    assert [r.status for r in made.collect()] == ["ok"] * 8
