from varimill.plans.batch import (
    daily_variance,
    forecasts,
    requests,
    scored_requests,
    unscored_requests,
)
from varimill.plans.ingest import (
    bars_job,
    changed_files,
    day_counts,
    file_counts,
    ingest_job,
    read_forecasts,
    refresh_daily_job,
    refresh_forecasts_job,
    upkeep_job,
)
from varimill.plans.jobs import (
    daily_forecast_job,
    daily_job,
    forecast_job,
    replay_job,
    stream_forecast_job,
)
from varimill.plans.streams import stream_daily_rv, stream_to_requests, stream_to_table
from varimill.plans.sweep import sweep

__all__ = [
    "bars_job",
    "changed_files",
    "daily_forecast_job",
    "daily_job",
    "daily_variance",
    "day_counts",
    "file_counts",
    "forecast_job",
    "forecasts",
    "ingest_job",
    "read_forecasts",
    "refresh_daily_job",
    "refresh_forecasts_job",
    "replay_job",
    "requests",
    "scored_requests",
    "stream_daily_rv",
    "stream_forecast_job",
    "stream_to_requests",
    "stream_to_table",
    "sweep",
    "unscored_requests",
    "upkeep_job",
]
