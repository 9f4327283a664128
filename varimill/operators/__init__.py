from varimill.operators.bars import (
    daily_rv,
    log_return_bars,
    merged_bars,
    merged_partials,
    partial_bars,
    with_event_time,
)
from varimill.operators.features import (
    first_requests,
    gate,
    history_rows,
    model_requests,
    model_sequences,
    request_payloads,
    rv_features,
)
from varimill.operators.models import LstmModel, SequenceScorer
from varimill.operators.replay import decode_dead_letters, replay
from varimill.operators.reports import (
    head_ordered,
    predictions_by_symbol,
    predictions_with_model,
    with_throughput,
)
from varimill.operators.scoring import (
    Outcome,
    bypass,
    har,
    parse_responses,
    score,
    split_scored,
    validate_requests,
)
from varimill.operators.ticks import (
    ingest_counts,
    invalid_reasons,
    select_days,
    tick_counts,
    valid_ticks,
    with_tick_counter,
)

__all__ = [
    "LstmModel",
    "Outcome",
    "SequenceScorer",
    "bypass",
    "daily_rv",
    "decode_dead_letters",
    "first_requests",
    "gate",
    "har",
    "head_ordered",
    "history_rows",
    "ingest_counts",
    "invalid_reasons",
    "log_return_bars",
    "merged_bars",
    "merged_partials",
    "model_requests",
    "model_sequences",
    "parse_responses",
    "partial_bars",
    "predictions_by_symbol",
    "predictions_with_model",
    "replay",
    "request_payloads",
    "rv_features",
    "score",
    "select_days",
    "split_scored",
    "tick_counts",
    "valid_ticks",
    "validate_requests",
    "with_event_time",
    "with_throughput",
    "with_tick_counter",
]
