"""Daily variance to model features, requests and sequences.

Everything here works on one row per symbol and day. All windows share one
partitioning and one order, so a whole chain costs a single shuffle of daily
rows, however many ticks lie behind them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from varimill.config import PipelineConfig
from varimill.functions import (
    expanding_history_sql,
    finite_sql,
    payload_json,
    utc_midnight_ms,
)

_DEFAULT = PipelineConfig()
FEATURES = ("rv_daily", "rv_weekly", "rv_monthly")
_BY_SYMBOL = "PARTITION BY symbol ORDER BY ts"
_WHOLE_SYMBOL = "(PARTITION BY symbol)"


def _last(rows: int) -> str:
    return f"({_BY_SYMBOL} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _means_sql(value: str, weekly: int, monthly: int, names: tuple[str, str]) -> list[str]:
    return [
        f"avg({value}) OVER {_last(weekly)} AS {names[0]}",
        f"avg({value}) OVER {_last(monthly)} AS {names[1]}",
    ]


def history_rows(
    daily: DataFrame, weekly: int = _DEFAULT.weekly, monthly: int = _DEFAULT.monthly
) -> DataFrame:
    """Every day with its running means and its row number per symbol.

    Frames count rows, not calendar days: a day without a value has no row.
    """
    means = _means_sql("rv_daily", weekly, monthly, FEATURES[1:])
    row_no = f"row_number() OVER ({_BY_SYMBOL}) AS day_no"
    return daily.selectExpr("symbol", "ts", "rv_daily", *means, row_no)


def _past_gate(test_start: date | str | None) -> str:
    return "true" if test_start is None else f"ts > {utc_midnight_ms(test_start)}L"


def gate(df: DataFrame, test_start: date | str | None = None) -> DataFrame:
    """Drop days ending at or before ``test_start`` (UTC midnight).

    Apply after the history windows: earlier days still fill the history.
    """
    return df.where(_past_gate(test_start))


def rv_features(
    daily: DataFrame, weekly: int = _DEFAULT.weekly, monthly: int = _DEFAULT.monthly
) -> DataFrame:
    """Daily, weekly and monthly variance of each day with a full history.

    Only a non-finite daily value drops the row; it stays in the frames of the
    days after it.
    """
    return (
        history_rows(daily, weekly, monthly)
        .where(f"day_no >= {monthly} AND {finite_sql('rv_daily')}")
        .select("symbol", "ts", *FEATURES)
    )


def model_requests(
    daily: DataFrame,
    test_start: date | str | None = None,
    weekly: int = _DEFAULT.weekly,
    monthly: int = _DEFAULT.monthly,
    decimals: int = _DEFAULT.payload_decimals,
) -> DataFrame:
    """One scoring request per emitted day: features, JSON text, model input.

    A day is emitted when its history is full, the gate is passed and its own
    value is finite; the first such day of a symbol sends its window along as
    warm-up history.

    ``sequence`` is the ``monthly`` x 3 matrix a sequence model holds when it
    gets the request: the last triples it was sent. The first accepted request
    (all three features finite) seeds it with expanding means over its window,
    each later one adds its own triple. Averaging over a series cut to start
    ``monthly - 1`` rows before that first request gives the same numbers, so
    nothing has to be carried from row to row. Triples that are not finite never
    reach the model, hence the frame over the running count of those that do.
    Values are rounded as the payload rounds them. A request that would be
    rejected has no sequence.
    """
    emitted = f"day_no >= {monthly} AND {_past_gate(test_start)} AND {finite_sql('rv_daily')}"
    rows = history_rows(daily, weekly, monthly).selectExpr(
        "*",
        f"{emitted} AS emitted",
        f"{emitted} AND {finite_sql(*FEATURES[1:])} AS accepted",
        f"collect_list(rv_daily) OVER {_last(monthly)} AS buffer",
    )
    rows = rows.selectExpr(
        "*",
        f"min(if(emitted, day_no, NULL)) OVER {_WHOLE_SYMBOL} AS first_no",
        f"min(if(accepted, day_no, NULL)) OVER {_WHOLE_SYMBOL} AS accepted_no",
    )

    cut = f"if(day_no > accepted_no - {monthly}, rv_daily, NULL)"
    parts = ("cut", "cut_weekly", "cut_monthly")
    rows = rows.selectExpr("*", f"{cut} AS cut", *_means_sql(cut, weekly, monthly, parts[1:]))
    triple = ", ".join(f"round({c}, {decimals})" for c in parts)
    rows = rows.selectExpr("*", f"if({finite_sql(*parts)}, array({triple}), NULL) AS triple")
    rows = rows.selectExpr(
        "*", f"count(triple) OVER ({_BY_SYMBOL} ROWS UNBOUNDED PRECEDING) AS triple_no"
    )
    held = (
        "(PARTITION BY symbol ORDER BY triple_no"
        f" RANGE BETWEEN {monthly - 1} PRECEDING AND CURRENT ROW)"
    )
    rows = rows.selectExpr("*", f"collect_list(triple) OVER {held} AS held")

    warm_up = f"if(day_no = first_no, {expanding_history_sql('buffer', weekly)}, NULL)"
    rows = rows.where("emitted").selectExpr(
        "symbol",
        "ts",
        *FEATURES,
        "day_no = first_no AS is_first",
        f"{warm_up} AS warm_up",
        "if(accepted, held, NULL) AS sequence",
    )
    payload = payload_json(FEATURES, "warm_up", decimals).alias("payload")
    return rows.select("symbol", "ts", *FEATURES, "is_first", payload, "sequence")


def request_payloads(daily: DataFrame, test_start: date | str | None = None, **kw) -> DataFrame:
    """Requests with their JSON text, without model sequences."""
    return model_requests(daily, test_start, **kw).drop("sequence")


def first_requests(daily: DataFrame, test_start: date | str | None = None, **kw) -> DataFrame:
    """The one request per symbol that opens its series."""
    opening = model_requests(daily, test_start, **kw).where("is_first")
    return opening.select("symbol", "ts", *FEATURES)


def model_sequences(daily: DataFrame, test_start: date | str | None = None, **kw) -> DataFrame:
    """Accepted requests with the model input of each."""
    accepted = model_requests(daily, test_start, **kw).where("sequence IS NOT NULL")
    return accepted.select("symbol", "ts", *FEATURES, "sequence")
