"""Daily variance stream to scoring requests, with state per symbol.

The state of a symbol is its last 22 days and the matrix its models hold, so it
does not grow with the stream. Python sees one row per symbol and day.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from varimill.config import PipelineConfig
from varimill.functions import payload_json, utc_midnight_ms
from varimill.schemas import MATRIX

_DEFAULT = PipelineConfig()
FEATURES = ("rv_daily", "rv_weekly", "rv_monthly")
_EMITTED = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    + [T.StructField("is_first", T.BooleanType())]
    + [T.StructField("history", MATRIX), T.StructField("sequence", MATRIX)]
)


def _mean(xs: list[float]) -> float:
    return sum(xs) / len(xs)


def _finite(xs: tuple[float, ...]) -> bool:
    return all(map(math.isfinite, xs))


class RequestHistory(StatefulProcessor):
    """Streaming counterpart of ``operators.model_requests``."""

    def __init__(self, gate_ms: int | None, weekly: int, monthly: int) -> None:
        self.gate_ms = gate_ms
        self.weekly = weekly
        self.monthly = monthly

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getListState("days", "ts LONG, rv DOUBLE")
        self.matrix = handle.getListState("matrix", "d DOUBLE, w DOUBLE, m DOUBLE")
        self.opened = handle.getValueState("opened", "opened BOOLEAN")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        out = self._advanced(key, rows)
        if out:
            yield pd.DataFrame(out, columns=_EMITTED.names)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Days of before the stream: they leave the state they would have left, and
        their requests, which are made already, are not made again."""
        self._advanced(key, iter([initialState]))

    def _advanced(self, key: Any, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """Take days in, in the order of time; the requests they give."""
        arrived = sorted(
            (int(ts), float(rv)) for part in rows for ts, rv in zip(part["ts"], part["rv_daily"])
        )
        days = [(ts, rv) for ts, rv in self.days.get()] if self.days.exists() else []
        matrix = [tuple(r) for r in self.matrix.get()] if self.matrix.exists() else []
        opened = self.opened.exists()
        out = []
        for ts, rv in arrived:
            days = sorted([*days, (ts, rv)])[-self.monthly :]
            values = [v for _, v in days]
            if len(values) < self.monthly:
                continue
            if self.gate_ms is not None and ts <= self.gate_ms:
                continue
            triple = (values[-1], _mean(values[-self.weekly :]), _mean(values))
            if not math.isfinite(triple[0]):
                continue
            warm_up = None
            if not opened or not matrix:
                warm_up = self._expanding(values)
            sequence = None
            if _finite(triple):
                matrix = (matrix + [triple] if matrix else warm_up)[-self.monthly :]
                sequence = [list(r) for r in matrix]
            history = None if opened else [list(r) for r in warm_up]
            out.append((key[0], ts, *triple, not opened, history, sequence))
            opened = True
        self.days.put(days)
        if matrix:
            self.matrix.put(matrix)
        if opened:
            self.opened.update((True,))
        return out

    def _expanding(self, values: list[float]) -> list[tuple[float, float, float]]:
        return [
            (v, _mean(values[max(0, i + 1 - self.weekly) : i + 1]), _mean(values[: i + 1]))
            for i, v in enumerate(values)
        ]

    def close(self) -> None:
        pass


def request_stream(
    daily: DataFrame,
    test_start: date | str | None = None,
    weekly: int = _DEFAULT.weekly,
    monthly: int = _DEFAULT.monthly,
    decimals: int = _DEFAULT.payload_decimals,
    history: DataFrame | None = None,
) -> DataFrame:
    """Requests of a daily variance stream, as ``model_requests`` gives in batch.

    ``history`` holds the days of before (``symbol``, ``ts``, ``rv_daily``), a batch
    frame such as ``read_daily`` gives: a new stream then goes on where they end and
    needs no days of its own to warm up. It is read when the first micro-batch runs,
    and has no effect on a stream that goes on from a checkpoint.

    Needs the RocksDB state store (``runs.available_now`` sets it).
    """
    gate_ms = None if test_start is None else utc_midnight_ms(test_start)
    before = None
    if history is not None:
        before = history.select("symbol", "ts", "rv_daily").groupBy("symbol")
    emitted = (
        daily.select("symbol", "ts", "rv_daily")
        .groupBy("symbol")
        .transformWithStateInPandas(
            RequestHistory(gate_ms, weekly, monthly),
            outputStructType=_EMITTED,
            outputMode="append",
            timeMode="None",
            initialState=before,
        )
    )
    payload = payload_json(FEATURES, "history", decimals).alias("payload")
    rounded = F.expr(f"transform(sequence, r -> transform(r, x -> round(x, {decimals})))")
    return emitted.select(
        "symbol", "ts", *FEATURES, "is_first", payload, rounded.alias("sequence")
    )
