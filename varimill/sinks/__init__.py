from varimill.sinks.bars import write_bars_bucketed
from varimill.sinks.metrics import append_metrics, read_metrics
from varimill.sinks.outcomes import (
    compact_predictions,
    prediction_rows,
    read_dead_letters,
    read_predictions,
    write_dead_letters_kafka,
    write_predictions_jdbc,
    write_scored,
)
from varimill.sinks.ticks import (
    land_ticks,
    tick_records,
    write_daily,
    write_file_ticks,
    write_ticks,
    write_ticks_csv,
    write_ticks_kafka,
)

__all__ = [
    "append_metrics",
    "compact_predictions",
    "land_ticks",
    "prediction_rows",
    "read_dead_letters",
    "read_metrics",
    "read_predictions",
    "tick_records",
    "write_bars_bucketed",
    "write_daily",
    "write_dead_letters_kafka",
    "write_file_ticks",
    "write_predictions_jdbc",
    "write_scored",
    "write_ticks",
    "write_ticks_csv",
    "write_ticks_kafka",
]
