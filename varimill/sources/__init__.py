from varimill.sources.csv import (
    day_names,
    list_files,
    read_csv_fields,
    read_ticks_csv,
    ticks_from_fields,
)
from varimill.sources.kafka import (
    dead_letters_from_records,
    kafka_options,
    read_dead_letters_kafka,
    read_ticks_kafka,
    ticks_from_records,
)
from varimill.sources.tables import (
    day_bound,
    read_daily,
    read_table,
    read_ticks,
    stream_table,
    ticks_from_events,
)

__all__ = [
    "day_bound",
    "day_names",
    "dead_letters_from_records",
    "kafka_options",
    "list_files",
    "read_csv_fields",
    "read_dead_letters_kafka",
    "read_daily",
    "read_table",
    "read_ticks",
    "read_ticks_csv",
    "read_ticks_kafka",
    "stream_table",
    "ticks_from_events",
    "ticks_from_fields",
    "ticks_from_records",
]
