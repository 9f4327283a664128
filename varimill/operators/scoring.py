"""Requests to predictions or dead letters.

The linear forecast and the input check are column expressions. Only a scorer
runs in Python, batch by batch inside the tasks; requests number one per symbol
and day, never one per tick.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.config import PipelineConfig
from varimill.functions import finite_sql, har_forecast
from varimill.schemas import RESPONSE_JSON

_DEFAULT = PipelineConfig()
FEATURES = ("rv_daily", "rv_weekly", "rv_monthly")

# Status of a request. A scorer answers OK, INVALID (never retried) or ERROR
# (retried); FAILED, TIMEOUT and BLOCKED are set here.
OK, INVALID, ERROR = "ok", "invalid", "error"
FAILED = "failed"  # every attempt ended in an error
TIMEOUT = "timeout"  # the time for all attempts was over
BLOCKED = "blocked"  # the breaker was open


@dataclass
class Outcome:
    """A scorer's answer, one entry per request; NaN predictions become null."""

    status: np.ndarray
    mamba: np.ndarray
    lstm: np.ndarray
    error: str | None = None


Scorer = Callable[[pa.RecordBatch], Outcome]


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``status``: invalid where a feature is missing, NaN or infinite."""
    ok = f"symbol IS NOT NULL AND {finite_sql(*FEATURES)}"
    return df.withColumn("status", F.expr(f"if({ok}, '{OK}', '{INVALID}')"))


def parse_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Read a scoring service's JSON answers from ``col``.

    Model outputs may be null; an answer without ``har`` is an error.
    """
    answer = df.withColumn("_answer", F.from_json(col, RESPONSE_JSON))
    return answer.selectExpr(
        *df.columns,
        "_answer.mamba AS mamba_pred",
        "_answer.lstm AS lstm_pred",
        "_answer.har AS har_pred",
        f"if(_answer.har IS NULL, '{ERROR}', '{OK}') AS status",
    )


def har(
    df: DataFrame,
    b: Sequence[float] = _DEFAULT.har,
    decimals: int | None = _DEFAULT.payload_decimals,
) -> DataFrame:
    """Add the linear forecast ``har_pred`` on features rounded as sent."""
    return df.withColumn("har_pred", har_forecast(FEATURES, b, decimals))


def bypass(requests: DataFrame) -> DataFrame:
    """Predictions with models switched off: features, null models, zero HAR."""
    return requests.selectExpr(
        "symbol",
        "ts",
        *FEATURES,
        "cast(NULL AS double) AS mamba_pred",
        "cast(NULL AS double) AS lstm_pred",
        "0D AS har_pred",
    )


@dataclass
class _Breaker:
    """Opens after ``threshold`` exhausted requests in a row, per task.

    Opening does not reset the count, so the first failure after the pause
    opens it again; a success does. The calls of a task share it.
    """

    threshold: int | None
    open_s: float
    clock: Callable[[], float]
    failures: int = 0
    open_until: float = float("-inf")
    lock: threading.Lock = field(default_factory=threading.Lock)

    def is_open(self) -> bool:
        with self.lock:
            return self.threshold is not None and self.clock() < self.open_until

    def record(self, succeeded: bool) -> None:
        with self.lock:
            if succeeded:
                self.failures = 0
                return
            self.failures += 1
            if self.threshold is not None and self.failures >= self.threshold:
                self.open_until = self.clock() + self.open_s


def _within(work: Callable[[], Outcome], seconds: float) -> Outcome | None:
    """The answer of ``work`` if it comes in time, else None.

    A call that hangs cannot be ended; its thread is left behind and does not keep the
    task alive.
    """
    answer: list[Outcome] = []
    thread = threading.Thread(target=lambda: answer.append(work()), daemon=True)
    thread.start()
    thread.join(max(seconds, 0.0))
    return answer[0] if answer else None


@dataclass(frozen=True)
class _Caller:
    """Calls a scorer for the batches of one task."""

    scorer: Scorer
    max_attempts: int
    backoff_ms: int
    breaker_threshold: int | None
    breaker_open_s: float
    capacity: int | None
    is_ready: Callable[[], bool] | None
    ready_poll_s: float
    ready_timeout_s: float
    sleep: Callable[[float], None]
    clock: Callable[[], float]
    in_flight: int = 1
    call_timeout_s: float | None = None
    total_timeout_s: float | None = None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = _Breaker(self.breaker_threshold, self.breaker_open_s, self.clock)
        ready = None
        for batch in batches:
            if ready is None:
                ready = self._wait_until_ready()
            yield self._score_batch(batch, breaker, ready)

    def _score_batch(
        self, batch: pa.RecordBatch, breaker: _Breaker, ready: bool
    ) -> pa.RecordBatch:
        n = batch.num_rows
        status = np.array(batch.column("status").to_pylist(), dtype=object)
        attempts = np.zeros(n, np.int32)
        errors = np.full(n, None, dtype=object)
        answer = Outcome(status, np.full(n, np.nan), np.full(n, np.nan))
        valid = np.flatnonzero(status == OK)
        size = self.capacity or max(len(valid), 1)
        calls = iter([valid[start : start + size] for start in range(0, len(valid), size)])
        turn = threading.Lock()

        def work() -> None:
            while True:
                with turn:
                    rows = next(calls, None)
                if rows is None:
                    return
                if not ready:
                    status[rows] = FAILED
                elif breaker.is_open():
                    status[rows] = BLOCKED
                else:
                    self._score_rows(batch, rows, answer, attempts, errors)
                    for outcome in status[rows]:
                        if outcome in (OK, FAILED, TIMEOUT):
                            breaker.record(outcome == OK)

        # Calls of a batch do not wait for each other; each writes to its own rows.
        others = [threading.Thread(target=work, daemon=True) for _ in range(self.in_flight - 1)]
        for thread in others:
            thread.start()
        work()
        for thread in others:
            thread.join()
        new = {
            "status": pa.array(status, pa.string()),
            "attempts": pa.array(attempts),
            "error": pa.array(errors, pa.string()),
            "mamba_pred": pa.array(answer.mamba, from_pandas=True),
            "lstm_pred": pa.array(answer.lstm, from_pandas=True),
        }
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | new
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def _score_rows(
        self,
        batch: pa.RecordBatch,
        rows: np.ndarray,
        answer: Outcome,
        attempts: np.ndarray,
        errors: np.ndarray,
    ) -> None:
        """Attempt ``rows`` together; each attempt repeats only those in error."""
        end = float("inf") if self.total_timeout_s is None else self.clock() + self.total_timeout_s
        for attempt in range(1, self.max_attempts + 1):
            out = self._in_time(batch.take(pa.array(rows)), end)
            attempts[rows] = attempt
            answer.status[rows] = out.status
            errors[rows] = np.where(out.status == OK, None, out.error)
            done = out.status == OK
            answer.mamba[rows[done]] = out.mamba[done]
            answer.lstm[rows[done]] = out.lstm[done]
            rows = rows[~done & (out.status != INVALID)]
            if not len(rows):
                return
            if self.clock() >= end:
                answer.status[rows] = TIMEOUT
                return
            if attempt < self.max_attempts:
                self.sleep(min(self.backoff_ms * 2 ** (attempt - 1) / 1000, end - self.clock()))
                if not self._wait_until_ready(end):
                    break
        answer.status[rows] = TIMEOUT if self.clock() >= end else FAILED

    def _in_time(self, requests: pa.RecordBatch, end: float) -> Outcome:
        """An attempt that is an error where it takes longer than a call may, or goes
        beyond the end of all attempts."""
        start = self.clock()
        limit = min(self.call_timeout_s or float("inf"), end - start)
        if limit == float("inf"):
            return self._attempt(requests)
        out = _within(lambda: self._attempt(requests), limit)
        if out is not None and self.clock() - start <= limit:
            return out
        n = requests.num_rows
        nothing = np.full(n, np.nan)
        return Outcome(np.full(n, ERROR, dtype=object), nothing, nothing, f"no answer within {limit:g} s")

    def _attempt(self, requests: pa.RecordBatch) -> Outcome:
        n = requests.num_rows
        try:
            out = self.scorer(requests)
            status = np.asarray(out.status, dtype=object)
            mamba, lstm = (np.asarray(x, dtype=np.float64) for x in (out.mamba, out.lstm))
            if not (len(status) == len(mamba) == len(lstm) == n):
                raise ValueError("scorer answered a different number of requests")
            return Outcome(status, mamba, lstm, out.error)
        except Exception as e:  # any scorer failure is one more failed attempt
            nothing = np.full(n, np.nan)
            return Outcome(np.full(n, ERROR, dtype=object), nothing, nothing, f"{type(e).__name__}: {e}")

    def _wait_until_ready(self, end: float = float("inf")) -> bool:
        if self.is_ready is None:
            return self.clock() < end
        give_up = min(self.clock() + self.ready_timeout_s, end)
        while not self.is_ready():
            if self.clock() >= give_up:
                return False
            self.sleep(self.ready_poll_s)
        return True


def score(
    requests: DataFrame,
    scorer: Scorer | None = None,
    *,
    b: Sequence[float] = _DEFAULT.har,
    decimals: int | None = _DEFAULT.payload_decimals,
    max_attempts: int = _DEFAULT.max_attempts,
    backoff_ms: int = _DEFAULT.backoff_ms,
    breaker_threshold: int | None = _DEFAULT.breaker_threshold,
    breaker_open_s: float = _DEFAULT.breaker_open_s,
    capacity: int | None = _DEFAULT.capacity,
    partitions: int | None = None,
    is_ready: Callable[[], bool] | None = None,
    ready_poll_s: float = 10.0,
    ready_timeout_s: float = 600.0,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
    in_flight: int = _DEFAULT.in_flight,
    call_timeout_s: float | None = None,
    total_timeout_s: float | None = None,
) -> DataFrame:
    """Score requests; every row keeps its request and gains ``status``.

    Status ``ok`` is a prediction, anything else a dead letter (see
    ``split_scored``). Invalid requests never reach the scorer. Requests in
    error are attempted ``max_attempts`` times with doubling pauses; a failing
    scorer never fails the job, and the last error's text is kept in ``error``.
    ``capacity`` bounds the requests per call (None: one call per Arrow batch).
    Requests are dealt to ``partitions`` tasks, by default the session's number of
    shuffle partitions: days are few bytes before models widen them, so the merging
    of small partitions would leave one task. The breaker counts requests in
    order and takes effect between calls. ``is_ready`` is polled before the
    first call of a task and between attempts.

    Up to ``in_flight`` calls of a task run at a time, each with its own attempts; their
    answers may come in any order. An attempt that takes longer than ``call_timeout_s``
    is an error; what has no answer ``total_timeout_s`` after its first attempt began,
    pauses included, gets the status ``timeout``. A scorer for several calls at a time
    must be safe for threads.

    A scorer may name the ``columns`` it looks at; the others, such as the payload, then
    stay in the JVM. Only answers come back.

    Without a scorer the model columns are null and no Python runs.
    """
    checked = har(validate_requests(requests), b, decimals)
    checked = checked.selectExpr(
        "*", "0 AS attempts", "cast(NULL AS double) AS mamba_pred", "cast(NULL AS double) AS lstm_pred",
        "cast(NULL AS string) AS error",
    )
    if scorer is None:
        return checked
    if not requests.isStreaming:
        partitions = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        checked = checked.repartition(partitions, "symbol", "ts")
    caller = _Caller(
        scorer,
        max_attempts,
        backoff_ms,
        breaker_threshold,
        breaker_open_s,
        capacity,
        is_ready,
        ready_poll_s,
        ready_timeout_s,
        sleep,
        clock,
        in_flight,
        call_timeout_s,
        total_timeout_s,
    )
    sent = getattr(scorer, "columns", None) or requests.columns
    answers = F.arrow_udf(_answers(caller), _ANSWER)
    # A scorer's answer need not be the same twice: it is asked once.
    answer = answers.asNondeterministic()(F.struct(*dict.fromkeys((*sent, "status"))))
    found = checked.withColumn("_answer", answer)
    return found.withColumns({f.name: F.col("_answer")[f.name] for f in _ANSWER}).drop("_answer")


_ANSWER = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("mamba_pred", T.DoubleType()),
        T.StructField("lstm_pred", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def _answers(caller: _Caller) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(requests: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for out in caller(map(pa.RecordBatch.from_struct_array, requests)):
            yield pa.StructArray.from_arrays([out.column(c) for c in _ANSWER.names], _ANSWER.names)

    return run


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, dead letters) of a scored frame.

    Split a frame that has been written (see ``sinks.write_scored``): splitting
    a lazy one would call the scorer once per side, with outcomes that need not
    agree.
    """
    predictions = scored.where(f"status = '{OK}'").select(
        "symbol", "ts", *FEATURES, "mamba_pred", "lstm_pred", "har_pred"
    )
    dead = scored.where(f"status <> '{OK}'").selectExpr(
        "symbol", "ts", "payload", "sequence", "status AS reason", "error"
    )
    return predictions, dead
