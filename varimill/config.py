"""Parameters of the pipeline, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date, timedelta

from pyspark.sql import SparkSession

CONF_PREFIX = "spark.varimill."


@dataclass(frozen=True)
class PipelineConfig:
    # These constants define the results and must not drift.
    bar_width: timedelta = timedelta(minutes=5)
    period: timedelta = timedelta(days=1)
    watermark: timedelta = timedelta(seconds=3)
    min_ticks: int = 2
    weekly: int = 5
    monthly: int = 22
    payload_decimals: int = 10
    har: tuple[float, float, float, float] = (0.1, 0.4, 0.3, 0.2)
    max_attempts: int = 3
    backoff_ms: int = 100
    breaker_threshold: int = 5
    breaker_open_s: float = 30.0
    call_timeout_s: float | None = 10.0
    total_timeout_s: float | None = 30.0

    # Limits towards other systems. ``capacity`` is the number of requests per
    # scorer call, after which the breaker may act; None makes one call of an Arrow
    # batch. ``in_flight`` calls of a task run at a time. ``scoring_partitions`` tasks score at a time; None takes the session's
    # number of shuffle partitions.
    capacity: int | None = 20
    in_flight: int = 1
    scoring_partitions: int | None = None
    sink_partitions: int = 4

    # Choices of a run.
    ml_enabled: bool = True
    test_start: date | None = None
    from_date: str | None = None
    last_n: int = 0

    @classmethod
    def from_session(cls, spark: SparkSession) -> PipelineConfig:
        """Run choices given as ``spark.varimill.<name>`` session settings."""
        parsers = {
            "ml_enabled": lambda s: s.strip().lower() == "true",
            "test_start": lambda s: date.fromisoformat(s.strip()),
            "from_date": str.strip,
            "last_n": int,
            "capacity": int,
            "in_flight": int,
            "scoring_partitions": int,
            "sink_partitions": int,
        }
        names = {f.name for f in fields(cls)} & parsers.keys()
        given = {n: spark.conf.get(CONF_PREFIX + n, None) for n in names}
        return cls(**{n: parsers[n](v) for n, v in given.items() if v})
