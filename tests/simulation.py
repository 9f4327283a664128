"""Plain-Python models of the semantics, for comparison with the Spark plans."""

import math
from collections import defaultdict

WEEKLY, MONTHLY = 5, 22


def mean(xs):
    return sum(xs) / len(xs)


def bars(ticks, width, min_ticks=2):
    """{(symbol, end): (log return, n)} of (symbol, ts, bid, seq) tuples."""
    groups = defaultdict(list)
    for symbol, ts, bid, seq in ticks:
        groups[symbol, ts - ts % width + width].append((ts, seq, bid))
    out = {}
    for key, rows in groups.items():
        if len(rows) >= min_ticks:
            out[key] = (math.log(max(rows)[2] / min(rows)[2]), len(rows))
    return out


def daily(bars_by_key, day=86_400_000):
    out = defaultdict(float)
    for (symbol, end), (r, _) in bars_by_key.items():
        last_instant = end - 1
        out[symbol, last_instant - last_instant % day + day] += r * r
    return dict(out)


def requests(days, gate_ms=None, decimals=10):
    """Client and model side of one symbol, run day by day.

    ``days`` are (ts, rv). The client keeps a window and sends warm-up history
    once; the model side holds what it was sent. A request the model side would
    reject leaves it as it was, and the seed is its first accepted request.
    """
    window, held, opened, out = [], [], False, []
    for ts, rv in sorted(days):
        window = [*window, rv][-MONTHLY:]
        if len(window) < MONTHLY or (gate_ms is not None and ts <= gate_ms):
            continue
        if not math.isfinite(window[-1]):
            continue
        triple = (window[-1], mean(window[-WEEKLY:]), mean(window))
        first, opened = not opened, True
        sequence = None
        if all(map(math.isfinite, triple)):
            if held:
                held = [*held, triple][-MONTHLY:]
            else:
                held = [
                    (v, mean(window[max(0, i - WEEKLY + 1) : i + 1]), mean(window[: i + 1]))
                    for i, v in enumerate(window)
                ]
            sequence = [[round(x, decimals) for x in t] for t in held]
        out.append((ts, *triple, first, sequence))
    return out
