from varimill.streaming.history import request_stream
from varimill.streaming.keeper import (
    batch_counts,
    corrected_bars,
    keep_bars,
    kept_bars,
    late_rows,
)
from varimill.streaming.letters import dead_letter_stream, replay_batches
from varimill.streaming.runs import (
    FLUSH_SYMBOL,
    available_now,
    daily_rv_stream,
    flush_tick,
    late_ticks,
    latest_event_ms,
    score_batches,
    send_flush,
    with_flush,
    write_batches,
)

__all__ = [
    "FLUSH_SYMBOL",
    "available_now",
    "batch_counts",
    "corrected_bars",
    "daily_rv_stream",
    "dead_letter_stream",
    "flush_tick",
    "keep_bars",
    "kept_bars",
    "late_rows",
    "late_ticks",
    "latest_event_ms",
    "replay_batches",
    "request_stream",
    "score_batches",
    "send_flush",
    "with_flush",
    "write_batches",
]
