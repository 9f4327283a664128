from varimill.functions.columns import (
    arrival_key,
    clock_text,
    day_name,
    event_time,
    expanding_history_sql,
    finite_sql,
    har_forecast,
    is_finite,
    millis,
    number_sql,
    payload_json,
    strip_sql,
    throughput,
    ts_sql,
    utc_midnight_ms,
)

__all__ = [
    "arrival_key",
    "clock_text",
    "day_name",
    "event_time",
    "expanding_history_sql",
    "finite_sql",
    "har_forecast",
    "is_finite",
    "millis",
    "number_sql",
    "payload_json",
    "strip_sql",
    "throughput",
    "ts_sql",
    "utc_midnight_ms",
]
