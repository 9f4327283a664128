"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of a tick time in daily files, read as UTC.
CLOCK_PATTERN = "^[0-9]{8} [0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}$"
DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def utc_midnight_ms(day: date | str) -> int:
    d = date.fromisoformat(day) if isinstance(day, str) else day
    return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp()) * 1000


def event_time(ts: str = "ts") -> Column:
    return F.expr(f"timestamp_millis({ts})")


def day_name(ts: str = "ts") -> Column:
    """UTC day of ``ts`` as ``yyyy-MM-dd``, whatever the session zone."""
    return F.expr(f"cast(date_from_unix_date(cast(floor({ts} / {DAY_MS}L) AS int)) AS string)")


def clock_text(ts: str = "ts") -> Column:
    """``ts`` as ``yyyyMMdd HH:mm:ss.SSS`` in UTC, whatever the session zone."""
    ms = f"pmod({ts}, {DAY_MS}L)"
    parts = ", ".join(
        f"cast({p} AS int)"
        for p in (
            f"{ms} div 3600000",
            f"{ms} div 60000 % 60",
            f"{ms} div 1000 % 60",
            f"{ms} % 1000",
        )
    )
    date = f"replace(cast(date_from_unix_date(cast(floor({ts} / {DAY_MS}L) AS int)) AS string), '-')"
    return F.expr(f"concat({date}, format_string(' %02d:%02d:%02d.%03d', {parts}))")


def finite_sql(*names: str) -> str:
    """SQL condition: every value is a number other than NaN and the infinities.

    x - x is 0 for a finite x and NaN otherwise.
    """
    return " AND ".join(f"coalesce({c} - {c} = 0D, false)" for c in names)


def is_finite(*names: str) -> Column:
    return F.expr(finite_sql(*names))


def strip_sql(text: str) -> str:
    """Cut control characters and blanks off both ends, not only spaces.

    Text that has none there, nearly all of it, skips the costly general trim.
    """
    blanks = "".join(f"\\u{c:04X}" for c in range(0x21))
    clean = f"ascii({text}) > 32 AND ascii(substring({text}, -1, 1)) > 32"
    return f"if({clean}, {text}, trim(BOTH '{blanks}' FROM {text}))"


def number_sql(text: str) -> str:
    """Decimal text to double, null when it is none.

    Of the spellings of NaN and infinity only the fixed ones count; the cast
    alone would take others too. A text that ends in a digit is none of them.
    """
    digit_last = f"ascii(substring({text}, -1, 1)) BETWEEN 48 AND 57"
    fixed = r"^[\\x00-\\x20]*[+-]?(NaN|Infinity)[\\x00-\\x20]*$"
    named = f"lower({text}) RLIKE 'nan|inf' AND NOT {text} RLIKE '{fixed}'"
    number = f"try_cast({text} AS double)"
    return f"CASE WHEN {digit_last} THEN {number} WHEN {named} THEN NULL ELSE {number} END"


def ts_sql(text: str) -> str:
    """Stripped tick time text to epoch milliseconds; null when it is neither form.

    All digits: already epoch milliseconds. Otherwise ``yyyyMMdd HH:mm:ss.SSS``
    in UTC, read by position, so the session zone has no say. A day past the
    end of its month means the last day, and 24:00:00.000 the next midnight.
    """

    def part(start: int, length: int) -> str:
        return f"cast(substring({text}, {start}, {length}) AS int)"

    year, month, day = part(1, 4), part(5, 2), part(7, 2)
    hour, minute, second, milli = part(10, 2), part(13, 2), part(16, 2), part(19, 3)
    of_day = f"(({hour} * 60 + {minute}) * 60 + {second}) * 1000 + {milli}"
    first = f"make_date({year}, {month}, 1)"
    offset = f"if({day} <= 28, {day}, least({day}, day(last_day({first})))) - 1"
    ok = (
        f"{year} > 0 AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31"
        f" AND {minute} < 60 AND {second} < 60 AND {of_day} <= {DAY_MS}"
    )
    clock = f"if({ok}, (unix_date({first}) + {offset}) * {DAY_MS}L + {of_day}, NULL)"
    return (
        f"CASE WHEN {text} RLIKE '{CLOCK_PATTERN}' THEN {clock}"
        f" WHEN {text} RLIKE '^[0-9]+$' THEN try_cast({text} AS bigint) END"
    )


def arrival_key(ts: str, seq: str | None, width: timedelta) -> Column:
    """One long that orders the ticks of one bar by ``(ts, seq)``.

    All ticks of a bar share the bar, so the offset inside it stands for the
    time. A long key lets ``min_by``/``max_by`` plan as HashAggregate; a struct
    key would sort. A sequence number too large to pack stops the job instead
    of silently reordering ties.
    """
    span = millis(width)
    offset = f"pmod({ts}, {span}L)"
    if seq is None:
        return F.expr(offset)
    limit = 1 << (62 - (span - 1).bit_length())
    number = f"coalesce({seq}, 0L)"
    message = f"seq outside [0, {limit}) for bars of {span} ms"
    return F.expr(
        f"CASE WHEN {number} BETWEEN 0L AND {limit - 1}L THEN {offset} * {limit}L + {number}"
        f" ELSE cast(raise_error('{message}') AS bigint) END"
    )


def _mean_sql(xs: str) -> str:
    return f"aggregate({xs}, 0D, (a, x) -> a + x) / size({xs})"


def expanding_history_sql(buffer: str, weekly: int) -> str:
    """``[d_i, mean of the last <= weekly, mean of all so far]`` for each i.

    The means see only the buffer itself, so the early rows average what there
    is.
    """
    start = f"greatest(i - {weekly - 2}, 1)"
    recent = _mean_sql(f"slice({buffer}, {start}, i + 2 - {start})")
    so_far = _mean_sql(f"slice({buffer}, 1, i + 1)")
    return f"transform({buffer}, (d, i) -> array(d, {recent}, {so_far}))"


def payload_json(features: Sequence[str], history: str, decimals: int) -> Column:
    """Scoring request text: fixed decimals, ``history`` only where not null."""
    num = f"%.{decimals}f"
    numbers = ",".join(f'"{c}":{num}' for c in features)
    # to_json escapes the symbol; its closing brace is cut off again.
    head = "trim(TRAILING '}' FROM to_json(named_struct('symbol', symbol)))"
    body = f"format_string(',{numbers}', {', '.join(features)})"
    row = f"format_string('[{num},{num},{num}]', r[0], r[1], r[2])"
    rows = f"array_join(transform({history}, r -> {row}), ',')"
    tail = f"if({history} IS NULL, '', concat(',\"history\":[', {rows}, ']'))"
    return F.expr(f"concat({head}, {body}, {tail}, '}}')")


def har_forecast(
    features: Sequence[str], weights: Sequence[float], decimals: int | None
) -> Column:
    """Linear forecast ``b0 + b1*daily + b2*weekly + b3*monthly``.

    ``decimals`` rounds the inputs first, as the text payload does; None keeps
    them as they are.
    """
    b0, *slopes = (f"cast('{float(b)!r}' AS double)" for b in weights)
    xs = features if decimals is None else [f"round({x}, {decimals})" for x in features]
    return F.expr(" + ".join([b0, *(f"{b} * {x}" for b, x in zip(slopes, xs, strict=True))]))


def throughput(ticks: str, elapsed_ms: str) -> Column:
    """Ticks per second, 0 when no time has passed."""
    return F.expr(f"if({elapsed_ms} > 0, {ticks} / ({elapsed_ms} / 1000D), 0D)")
