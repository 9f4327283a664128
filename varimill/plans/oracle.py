"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

TEST_START_MS = 1706140800000  # 2024-01-25 00:00 UTC

_TICKS = """
ticks AS (
  SELECT {symbol} AS symbol, epoch_us(ts) // 1000 AS ts, value AS bid,
         value + CAST(CAST(json_extract_string(props, '$.k') AS INT) - 5 AS DOUBLE)
                 / CAST(100 AS DOUBLE) AS ask,
         CAST(user_id % 50 AS DOUBLE) - 1 AS volume, event_id AS seq
  FROM events)
"""
_VALID_CONDITION = (
    "ts > 0 AND NOT isnan(bid) AND bid > 0 AND NOT isnan(ask) AND ask > 0"
    " AND ask >= bid AND NOT isnan(volume) AND volume >= 0"
)
_DAY = "strftime(make_timestamp(ts * 1000), '%Y-%m-%d')"


def _ctes(symbol: str = "event_type", width_ms: int = 300000, gate: str = "TRUE") -> str:
    """Stages of the pipeline as common table expressions."""
    return f"""
WITH {_TICKS.format(symbol=symbol)},
valid AS (SELECT * FROM ticks WHERE {_VALID_CONDITION}),
bars AS (
  SELECT symbol, ts - ts % {width_ms} + {width_ms} AS ts,
         ln(arg_max(bid, (ts, seq)) / arg_min(bid, (ts, seq))) AS log_return,
         count(*) AS n_ticks
  FROM valid GROUP BY symbol, ts - ts % {width_ms} HAVING count(*) >= 2),
daily AS (
  SELECT symbol, (ts - 1) - (ts - 1) % 86400000 + 86400000 AS ts,
         sum(log_return * log_return) AS rv_daily
  FROM bars GROUP BY ALL),
history AS (
  SELECT *,
    avg(rv_daily) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
      AS rv_weekly,
    avg(rv_daily) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)
      AS rv_monthly,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS day_no
  FROM daily),
emitted AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 AS is_first
  FROM history WHERE day_no >= 22 AND isfinite(rv_daily) AND {gate}),
cut AS (
  SELECT h.symbol, h.ts, h.rv_daily,
    avg(h.rv_daily) OVER (PARTITION BY h.symbol ORDER BY h.ts
      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w,
    avg(h.rv_daily) OVER (PARTITION BY h.symbol ORDER BY h.ts
      ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS m,
    h.day_no
  FROM history h JOIN emitted f ON f.is_first AND f.symbol = h.symbol
  WHERE h.day_no >= f.day_no - 21)
"""


_GATED = _ctes(gate=f"ts > {TEST_START_MS}")
_FEATURES = (
    "round(rv_daily, {d}) AS rv_daily, round(rv_weekly, {d}) AS rv_weekly,"
    " round(rv_monthly, {d}) AS rv_monthly"
)
_F8, _F6 = _FEATURES.format(d=8), _FEATURES.format(d=6)
_HAR = "0.1 + 0.4 * round(rv_daily, 10) + 0.3 * round(rv_weekly, 10) + 0.2 * round(rv_monthly, 10)"
_HAR6 = f"round(CAST({_HAR} AS DOUBLE), 6) AS har_pred"
_NULL_MODELS = "CAST(NULL AS DOUBLE) AS mamba_pred, CAST(NULL AS DOUBLE) AS lstm_pred"
_TICK_COLUMNS = (
    "symbol, ts, round(bid, 8) AS bid, round(ask, 8) AS ask, round(volume, 8) AS volume,"
    " round(ask - bid, 8) AS spread"
)
_WEEKDAY = "(ts // 86400000 % 7)"
_STATUS = f"CASE {_WEEKDAY} WHEN 0 THEN 'invalid' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'ok' END"
_RUNS = f"""
WITH {_TICKS.format(symbol="event_type")},
runs AS (
  SELECT {_DAY} AS run_timestamp, CAST(8 AS INTEGER) AS parallelism,
         CAST(16 AS INTEGER) AS input_partitions, CAST(60000 AS BIGINT) AS checkpoint_ms,
         TRUE AS ml_enabled, count(*) AS total_ticks, max(ts) - min(ts) AS elapsed_ms
  FROM ticks GROUP BY 1)
SELECT *, round(CASE WHEN elapsed_ms > 0
                     THEN total_ticks / (elapsed_ms / CAST(1000 AS DOUBLE))
                     ELSE CAST(0 AS DOUBLE) END, {{d}}) AS throughput_ticks_per_sec
FROM runs
"""


def _payload(history: str) -> str:
    numbers = '"rv_daily":%.10f,"rv_weekly":%.10f,"rv_monthly":%.10f'
    return (
        f"'{{\"symbol\":\"' || symbol || '\",' ||"
        f" printf('{numbers}', rv_daily, rv_weekly, rv_monthly) || {history} || '}}'"
    )


_WARM_UP = """
, warm_up AS (
  SELECT c.symbol,
    ',"history":[' || string_agg(printf('[%.10f,%.10f,%.10f]', c.rv_daily, c.w, c.m), ','
      ORDER BY c.ts) || ']' AS history
  FROM cut c JOIN emitted f ON f.is_first AND f.symbol = c.symbol
  WHERE c.day_no <= f.day_no GROUP BY c.symbol)
"""


def _payload_rows(ctes: str, columns: str, where: str = "TRUE") -> str:
    history = "CASE WHEN is_first THEN history ELSE '' END"
    return (
        f"{ctes} {_WARM_UP} SELECT {columns}, {_payload(history)} AS payload"
        f" FROM emitted JOIN warm_up USING (symbol) WHERE {where}"
    )


def _selected(days: str) -> str:
    """Ticks of the last 20 days from 2024-01-05 on."""
    return f"""
WITH {_TICKS.format(symbol="event_type")},
named AS (SELECT *, {_DAY} AS day FROM ticks),
ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY day DESC) AS newest FROM named WHERE day >= '2024-01-05')
SELECT {_TICK_COLUMNS}, {days} FROM ranked WHERE newest <= 20
"""


def _lstm_sql(ctes: str) -> str:
    """The forward pass step by step, with the weights as literals."""
    from varimill.plans.catalog import SMALL_LSTM as m

    def listed(values) -> str:
        return "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values) + "]"

    hidden = m.w_hh.shape[1]
    gates = f"range(1, {4 * hidden + 1})"
    rows = {k: "[" + ", ".join(listed(r) for r in w) + "]" for k, w in (("w_ih", m.w_ih), ("w_hh", m.w_hh))}
    sigmoid = "(1 / (1 + exp(-({}))))".format
    tanh = "(1 - 2 / (exp(2 * ({})) + 1))".format
    j = f"range(1, {hidden + 1})"
    start = listed([0.0] * hidden)
    return ctes.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
inputs AS (
  SELECT e.symbol, e.ts, CAST(c.day_no - e.day_no + 21 AS INTEGER) AS step,
         [round(c.rv_daily, 10), round(c.w, 10), round(c.m, 10)] AS x
  FROM emitted e JOIN cut c
    ON c.symbol = e.symbol AND c.day_no BETWEEN e.day_no - 21 AND e.day_no),
weights AS (SELECT {rows["w_ih"]} AS w_ih, {rows["w_hh"]} AS w_hh, {listed(m.b_ih + m.b_hh)} AS b),
run AS (
  SELECT symbol, ts, 0 AS step, {start} AS h, {start} AS c FROM emitted
  UNION ALL
  SELECT symbol, ts, step + 1,
         list_transform({j}, lambda k: {sigmoid(f"pre[k + {3 * hidden}]")} * {tanh("c2[k]")}) AS h, c2 AS c
  FROM (
    SELECT symbol, ts, step, pre,
           list_transform({j}, lambda k: {sigmoid(f"pre[k + {hidden}]")} * c[k]
             + {sigmoid("pre[k]")} * {tanh(f"pre[k + {2 * hidden}]")}) AS c2
    FROM (
      SELECT r.symbol, r.ts, r.step, r.c,
             list_transform({gates}, lambda k: b[k] + list_dot_product(w_ih[k], x)
               + list_dot_product(w_hh[k], r.h)) AS pre
      FROM run r JOIN inputs i ON i.symbol = r.symbol AND i.ts = r.ts AND i.step = r.step, weights)))
SELECT e.symbol, e.ts, {_F6.replace("rv_", "e.rv_").replace("AS e.rv_", "AS rv_")}, CAST(NULL AS DOUBLE) AS mamba_pred,
       round(list_dot_product({listed(m.head_w[0])}, h) + {float(m.head_b[0])!r}, 6) AS lstm_pred, {_HAR6}
FROM emitted e JOIN run r ON r.symbol = e.symbol AND r.ts = e.ts AND r.step = 22"""


# What is left of the ticks after the corrections of the daily files.
_CORRECTED = f"""corrected AS (
  SELECT *, {_DAY} AS day FROM ticks
  WHERE {_DAY} <> '2024-01-09' AND NOT ({_DAY} = '2024-01-08' AND seq % 3 = 0)),
filed AS (
  SELECT *, CASE WHEN day = '2024-01-10' AND seq % 5 = 0 THEN '2024-02-15' ELSE day END AS file_name
  FROM corrected)"""


def _after_corrections() -> dict[str, str]:
    ctes = f"WITH {_TICKS.format(symbol='event_type')}, {_CORRECTED}"
    counted = f"{ctes} SELECT file_name, count(*) AS ticks FROM filed GROUP BY file_name"
    daily = _ctes().replace("valid AS (SELECT * FROM ticks", f"{_CORRECTED},\nvalid AS (SELECT * FROM corrected")
    return {
        "corrected_files": f"{ctes} SELECT {_TICK_COLUMNS}, day FROM corrected",
        # An emptied file is known, with no tick.
        "corrected_counts": f"{counted} UNION ALL SELECT '2024-01-09', 0"
        " UNION ALL SELECT 'total', count(*) FROM filed",
        "corrected_days": f"""{ctes}
SELECT day, count(*) AS ticks, count(*) FILTER (WHERE {_VALID_CONDITION}) AS valid,
       count(DISTINCT file_name) AS files, day IN ('2024-01-08', '2024-01-10') AS anew
FROM filed GROUP BY day""",
        "corrected_forecasts": f"{daily} SELECT symbol, ts, {_F6}, {_NULL_MODELS}, {_HAR6} FROM emitted",
        "corrected_daily_rv": f"{daily} SELECT symbol, ts, round(rv_daily, 8) AS rv_daily FROM daily",
    }


_DELIVERIES = f"""delivered AS (
  SELECT *, CASE WHEN {_DAY} < '2024-01-11' AND seq % 11 = 0 THEN 2 WHEN {_DAY} < '2024-01-11' THEN 0
                 WHEN {_DAY} < '2024-01-24' THEN 1 ELSE 2 END AS batch_id
  FROM ticks),
marks AS (
  SELECT b.batch_id, max(d.ts) - 3000 AS mark
  FROM (VALUES (0), (1), (2)) AS b(batch_id) JOIN delivered d ON d.batch_id <= b.batch_id
  WHERE {_VALID_CONDITION} GROUP BY b.batch_id),
judged AS (
  SELECT d.*, coalesce(d.ts - d.ts % 300000 + 300000 <= m.mark, FALSE) AND {_VALID_CONDITION} AS late
  FROM delivered d LEFT JOIN marks m ON m.batch_id = d.batch_id - 1)"""


def _kept_streams(plain: str, bars: str) -> dict[str, str]:
    ctes = f"WITH {_TICKS.format(symbol='event_type')}, {_DELIVERIES}"
    in_time = _ctes().replace("valid AS (SELECT * FROM ticks", f"{_DELIVERIES},\nvalid AS (SELECT * FROM judged")
    in_time = in_time.replace(f"FROM judged WHERE {_VALID_CONDITION}", f"FROM judged WHERE NOT late AND {_VALID_CONDITION}")
    return {
        "stream_late_ticks": f"""{ctes}
SELECT symbol, ts, round(bid, 8) AS bid, round(ask, 8) AS ask, round(volume, 8) AS volume, seq
FROM judged WHERE late""",
        "stream_kept_bars": f"{in_time} {bars}",
        "stream_corrected_bars": f"{plain} {bars}",
        "stream_two_sources": f"{plain} {bars}",
        "stream_batch_counts": f"""{ctes}
SELECT CAST(j.batch_id AS BIGINT) AS batch_id, count(*) AS ticks,
       count(*) FILTER (WHERE {_VALID_CONDITION}) AS valid, count(*) FILTER (WHERE late) AS late,
       min(m.mark) AS mark
FROM judged j JOIN marks m ON m.batch_id = j.batch_id GROUP BY j.batch_id""",
        "stream_moved_by_all": f"""WITH {_TICKS.format(symbol='event_type')},
parts AS (
  SELECT *, CASE WHEN {_DAY} < '2024-01-11' THEN 0 WHEN {_DAY} < '2024-01-24' THEN 1 ELSE 2 END AS part
  FROM ticks)
SELECT CAST(part AS BIGINT) AS batch_id, count(*) + CASE part WHEN 0 THEN 1 ELSE 0 END AS ticks,
       count(*) FILTER (WHERE {_VALID_CONDITION}) AS valid,
       CASE part WHEN 0 THEN 0 ELSE count(*) FILTER (WHERE {_VALID_CONDITION}) END AS late,
       CAST(1893456000000 - 3000 AS BIGINT) AS mark
FROM parts GROUP BY part""",
    }


def oracle_sql() -> dict[str, str]:
    plain = _ctes()
    replayed = f"""{plain}
SELECT symbol, ts,
       CASE {_WEEKDAY} WHEN 0 THEN 'invalid' WHEN 1 THEN 'failed' ELSE 'ok' END AS status,
       CAST(CASE {_WEEKDAY} WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
       CASE {_WEEKDAY} WHEN 2 THEN CAST(1 AS DOUBLE) END AS lstm_pred, {_HAR6}
FROM emitted WHERE {_WEEKDAY} <= 2"""
    har = f"{plain} SELECT symbol, ts, {_F6}, {_NULL_MODELS}, {_HAR6} FROM emitted"
    daily = f"{plain} SELECT symbol, ts, round(rv_daily, 8) AS rv_daily FROM daily"
    payloads = _payload_rows(_GATED, "symbol, ts, is_first")
    tick_rows = f"WITH {_TICKS.format(symbol='event_type')} SELECT {_TICK_COLUMNS}, seq FROM ticks"
    bars = "SELECT symbol, ts, round(log_return, 8) AS log_return, n_ticks FROM bars"
    after_replay = f"""{plain}
SELECT symbol, ts,
       CASE {_WEEKDAY} WHEN 0 THEN 'invalid' WHEN 1 THEN 'failed' ELSE 'prediction' END AS side,
       CASE WHEN {_WEEKDAY} = 2 THEN CAST(1 AS DOUBLE)
            WHEN {_WEEKDAY} > 2 THEN {_WEEKDAY} * CAST(0.5 AS DOUBLE) END AS lstm_pred
FROM emitted"""
    return {
        "ticks_from_events": tick_rows,
        "csv_fields_typed": tick_rows.replace(
            "SELECT symbol, ts,", "SELECT CASE WHEN seq % 31 = 0 THEN '' ELSE symbol END AS symbol, ts,"
        )
        + " WHERE seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 23 <> 0"
        " AND seq % 29 <> 0",
        "csv_daily_files": _selected("day AS file_name"),
        "ingest_window": _selected("seq, day"),
        "ingest_counts": f"""
WITH {_TICKS.format(symbol="event_type")}, named AS (SELECT {_DAY} AS day FROM ticks)
SELECT day, count(*) AS ticks FROM named GROUP BY day
UNION ALL SELECT 'total', count(*) FROM named""",
        "tick_day_table": f"""
WITH {_TICKS.format(symbol="event_type")}
SELECT {_TICK_COLUMNS}, seq, {_DAY} AS day FROM ticks WHERE {_DAY} >= '2024-01-05'""",
        "valid_ticks": f"{plain} SELECT {_TICK_COLUMNS}, seq FROM valid",
        "invalid_tick_reasons": f"""
WITH {_TICKS.format(symbol="event_type")},
named AS (
  SELECT symbol, ts, seq, concat_ws(',',
    CASE WHEN NOT (ts > 0) THEN 'ts' END,
    CASE WHEN isnan(bid) OR NOT (bid > 0) THEN 'bid' END,
    CASE WHEN isnan(ask) OR NOT (ask > 0) THEN 'ask' END,
    CASE WHEN isnan(bid) OR isnan(ask) OR NOT (ask >= bid) THEN 'crossed' END,
    CASE WHEN isnan(volume) OR NOT (volume >= 0) THEN 'volume' END) AS reasons
  FROM ticks)
SELECT * FROM named WHERE reasons <> ''""",
        "tick_counter": f"""
WITH {_TICKS.format(symbol="event_type")}
SELECT count(*) AS ticks, count(*) FILTER (WHERE {_VALID_CONDITION}) AS valid FROM ticks""",
        "bars_5m": f"{plain} {bars}",
        "bars_merged": f"{plain} {bars}",
        **_after_corrections(),
        **_kept_streams(plain, bars),
        "bars_60m": f"{_ctes(width_ms=3600000)} {bars}",
        "daily_rv": daily,
        "daily_rv_one_symbol": f"{_ctes(symbol=chr(39) + 'ALL' + chr(39))}"
        " SELECT symbol, ts, round(rv_daily, 8) AS rv_daily FROM daily",
        "daily_rv_60m": f"{_ctes(width_ms=3600000)}"
        " SELECT symbol, ts, round(rv_daily, 8) AS rv_daily FROM daily",
        "bucketed_daily_rv": daily,
        "rv_features": f"{plain} SELECT symbol, ts, {_F8} FROM emitted",
        "rv_features_gated": f"{_GATED} SELECT symbol, ts, {_F8} FROM emitted",
        "first_requests": f"{_GATED} SELECT symbol, ts, {_F8} FROM emitted WHERE is_first",
        "request_payloads": payloads,
        "model_sequences": f"""{_GATED}
SELECT e.symbol, e.ts, CAST(c.day_no - e.day_no + 21 AS INTEGER) AS step,
       round(c.rv_daily, 10) AS rv_daily, round(c.w, 10) AS rv_weekly, round(c.m, 10) AS rv_monthly
FROM emitted e JOIN cut c
  ON c.symbol = e.symbol AND c.day_no BETWEEN e.day_no - 21 AND e.day_no""",
        "har_predictions": har,
        "har_predictions_one_symbol": f"{_ctes(symbol=chr(39) + 'ALL' + chr(39))}"
        f" SELECT symbol, ts, {_F6}, {_NULL_MODELS}, {_HAR6} FROM emitted",
        "bypass_predictions": f"{plain} SELECT symbol, ts, {_F6}, {_NULL_MODELS},"
        " CAST(0 AS DOUBLE) AS har_pred FROM emitted",
        "scored_status": f"""{plain}
SELECT symbol, ts, {_STATUS} AS status,
       CAST(CASE WHEN {_STATUS} = 'failed' THEN 3 ELSE 1 END AS INTEGER) AS attempts,
       CASE WHEN {_STATUS} = 'ok' THEN {_WEEKDAY} * CAST(0.5 AS DOUBLE) END AS lstm_pred, {_HAR6}
FROM emitted""",
        "calls_in_flight": f"""{plain}
SELECT symbol, ts, {_STATUS} AS status,
       CAST(CASE WHEN {_STATUS} = 'failed' THEN 3 ELSE 1 END AS INTEGER) AS attempts,
       CASE WHEN {_STATUS} = 'ok' THEN {_WEEKDAY} * CAST(0.5 AS DOUBLE) END AS lstm_pred, {_HAR6}
FROM emitted""",
        "slow_service": f"""{plain}
SELECT symbol, ts, CASE WHEN ts // 86400000 % 4 <= 1 THEN 'ok' ELSE 'timeout' END AS status,
       CAST(CASE ts // 86400000 % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS attempts,
       CASE WHEN ts // 86400000 % 4 <= 1 THEN CAST(0.5 AS DOUBLE) END AS lstm_pred,
       CASE ts // 86400000 % 4 WHEN 2 THEN 'no answer within 5.7 s'
                               WHEN 3 THEN 'no answer within 10 s' END AS error
FROM emitted""",
        "dead_letters": _payload_rows(
            plain,
            f"symbol, ts, {_STATUS} AS reason, CAST(22 AS INTEGER) AS steps",
            f"{_WEEKDAY} <= 2",
        ),
        "replayed": replayed,
        "stored_predictions": f"""{plain}
SELECT symbol, ts, CASE WHEN {_STATUS} = 'ok' THEN 'prediction' ELSE {_STATUS} END AS side,
       CASE WHEN {_STATUS} = 'ok' THEN round(CAST({_HAR} AS DOUBLE), 6) END AS har_pred
FROM emitted""",
        "responses_parsed": f"""{plain}
SELECT symbol, ts, CAST(NULL AS DOUBLE) AS mamba_pred,
       CASE WHEN ts // 86400000 % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS lstm_pred,
       CASE WHEN ts // 86400000 % 5 <> 0 THEN round(CAST({_HAR} AS DOUBLE), 6) END AS har_pred,
       CASE WHEN ts // 86400000 % 5 <> 0 THEN 'ok' ELSE 'error' END AS status
FROM emitted""",
        "predictions_by_symbol": f'{plain} SELECT symbol, count(*) AS "count" FROM emitted'
        ' GROUP BY symbol ORDER BY "count" DESC, symbol',
        "predictions_with_model": f"{plain} SELECT count(*) AS lstm_pred,"
        " CAST(0 AS BIGINT) AS mamba_pred FROM emitted",
        "predictions_head": f"{plain} SELECT symbol, ts, {_F6}, {_NULL_MODELS}, {_HAR6}"
        " FROM emitted ORDER BY ts, symbol LIMIT 10",
        "throughput": _RUNS.format(d=6),
        "run_metrics": _RUNS.format(d=2),
        "parallelism_sweep": """
SELECT CAST(i AS INTEGER) AS input_partitions, CAST(s AS INTEGER) AS parallelism, total_ticks
FROM (SELECT count(*) AS total_ticks FROM events),
     (VALUES (2), (8)) AS a(i), (VALUES (4), (8)) AS b(s)""",
        "lstm_scores": _lstm_sql(plain),
        "short_sequences": har,
        "stream_predictions": har,
        "incremental_forecast": har,
        # Days end at the next midnight.
        "stream_from_history": f"{har} WHERE ts > {TEST_START_MS - 86400000}",
        "stream_continued": har,
        "nonfinite_days": f"""{_ctes().replace(
            "sum(log_return * log_return) AS rv_daily",
            "sum(log_return * log_return) + max(CASE WHEN (ts - 1) - (ts - 1) % 86400000 + 86400000"
            " = 1704499200000 THEN CAST('inf' AS DOUBLE) ELSE 0 END) AS rv_daily")}
SELECT symbol, ts,
       CASE WHEN isfinite(rv_weekly) AND isfinite(rv_monthly) THEN 'ok' ELSE 'invalid' END AS status,
       round(rv_monthly, 6) AS rv_monthly, {_HAR6}
FROM emitted""",
        "invalid_requests": f"""{plain}
SELECT symbol, ts, CASE WHEN {_WEEKDAY} <= 2 THEN 'invalid' ELSE 'ok' END AS status,
       CAST(CASE WHEN {_WEEKDAY} <= 2 THEN 0 ELSE 1 END AS INTEGER) AS attempts FROM emitted""",
        "raising_scorer": f"""{plain}
SELECT symbol, ts, 'failed' AS status, CAST(3 AS INTEGER) AS attempts,
       'RuntimeError: out of order' AS error FROM emitted""",
        "breaker_open": f"""{plain}
SELECT 'failed' AS status, CAST(3 AS INTEGER) AS attempts, CAST(5 AS BIGINT) AS requests
UNION ALL SELECT 'blocked', CAST(0 AS INTEGER), count(*) - 5 FROM emitted""",
        "service_not_ready": f"""{plain}
SELECT symbol, ts, 'failed' AS status, CAST(0 AS INTEGER) AS attempts FROM emitted""",
        "broken_payloads": f"""{plain}
SELECT symbol, ts, 'invalid' AS status, CAST(0 AS INTEGER) AS attempts
FROM emitted WHERE {_WEEKDAY} <= 2""",
        "replayed_at_processing_time": f"""{plain}
SELECT symbol, ts AS letter_ts, TRUE AS at_replay FROM emitted WHERE {_WEEKDAY} <= 2""",
        "prediction_rows": f"{plain} SELECT symbol, ts, {_F6}, {_NULL_MODELS}, {_HAR6},"
        " TRUE AS stamped, TRUE AS id_of_key FROM emitted",
        "store_after_replay": after_replay,
        "compacted_store": after_replay,
        "ingested_twice": f"""
WITH {_TICKS.format(symbol="event_type")} SELECT {_TICK_COLUMNS}, {_DAY} AS day FROM ticks""",
        "stream_daily_rv": daily,
        "stream_requests": payloads,
        "stream_replayed": replayed,
    }
