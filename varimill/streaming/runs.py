"""Running the tick pipeline as a stream over what is there now.

A stream closes a window only when the watermark passes it, so the last day of
a finished input stays open until a later tick arrives. ``send_flush`` supplies
one, dated just past the end of that day: the next day can still come. Spark's watermark is the newest time seen in a micro-batch less the delay:
input must arrive in rough time order across batches, or ticks are dropped as
late. Backfill unordered input in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from varimill.config import PipelineConfig
from varimill.functions import millis
from varimill.operators.bars import daily_rv, log_return_bars, with_event_time
from varimill.operators.scoring import score
from varimill.operators.ticks import valid_ticks, with_tick_counter
from varimill.schemas import TICK
from varimill.sinks.outcomes import write_scored

_DEFAULT = PipelineConfig()
# Reserved: only moves time and is left out of all results.
FLUSH_SYMBOL = "__flush__"
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def daily_rv_stream(
    ticks: DataFrame,
    delay: timedelta = _DEFAULT.watermark,
    width: timedelta = _DEFAULT.bar_width,
    min_ticks: int = _DEFAULT.min_ticks,
    period: timedelta = _DEFAULT.period,
) -> DataFrame:
    """Daily variance of a tick stream; all ticks, valid or not, are counted.

    Only valid ticks move the watermark: the filter ends up below it.
    """
    timed = with_event_time(with_tick_counter(ticks), delay)
    daily = daily_rv(log_return_bars(valid_ticks(timed), width, min_ticks), period)
    # The sum is never null; naming it keeps this filter above the watermark, which
    # the flush must reach.
    return daily.where(f"symbol <> '{FLUSH_SYMBOL}' OR rv_daily IS NULL")


def late_ticks(query: StreamingQuery) -> int:
    """Rows that the last micro-batches of a query dropped as late, as far as its
    progress goes back: ticks first, and bars in the second window."""
    operators = (op for p in query.recentProgress for op in p["stateOperators"])
    return sum(op["numRowsDroppedByWatermark"] for op in operators)


def flush_tick(spark: SparkSession, at_ms: int) -> DataFrame:
    return spark.createDataFrame([(FLUSH_SYMBOL, at_ms, 1.0, 1.0, 0.0, 0.0, 0)], TICK)


def send_flush(
    spark: SparkSession,
    path: str,
    after_ms: int,
    delay: timedelta = _DEFAULT.watermark,
    period: timedelta = _DEFAULT.period,
) -> None:
    """Close every window so far, the period of ``after_ms`` included.

    The tick lies one millisecond past that period's end and the delay, so no tick
    of the next period comes late. Sent again, it replaces itself; after an
    ``after_ms`` that is such a tick's own time, too.
    """
    span, past_end = millis(period), millis(delay) + 1
    flushed = (after_ms - past_end) % span == 0
    at_ms = after_ms if flushed else after_ms // span * span + span + past_end
    flush_tick(spark, at_ms).coalesce(1).write.mode("overwrite").parquet(f"{path}/at-{at_ms}")


def with_flush(ticks: DataFrame, path: str) -> DataFrame:
    """The tick stream plus the ticks ``send_flush`` puts under ``path``."""
    spark = ticks.sparkSession
    # A stream must find its directory when it starts.
    spark.createDataFrame([], TICK).write.mode("ignore").parquet(path)
    flushes = spark.readStream.schema(TICK).option("recursiveFileLookup", True).parquet(path)
    return ticks.select(*TICK.names).unionByName(flushes)


def _epoch_ms(text: str) -> int:
    at = datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1000)


def latest_event_ms(query: StreamingQuery, delay: timedelta = _DEFAULT.watermark) -> int:
    """Newest event time a finished query has seen, 0 if none.

    Progress goes back some micro-batches only; what came before them is in the
    watermark, which never falls.
    """
    times = [p["eventTime"] for p in query.recentProgress if p.get("eventTime")]
    newest = [_epoch_ms(t["max"]) for t in times if t.get("max")]
    marks = [_epoch_ms(t["watermark"]) for t in times if t.get("watermark")]
    return max([0, *newest, *(m + millis(delay) for m in marks if m > 0)])


def write_batches(root: str) -> Callable[[DataFrame, int], None]:
    """Batch writer to Parquet; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return write


def score_batches(
    root: str, scorer=None, sink_partitions: int | None = None, **options
) -> Callable[[DataFrame, int], None]:
    """Batch writer that scores requests into predictions and dead letters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_scored(score(batch, scorer, **options), batch_id, root, sink_partitions)

    return write


@contextmanager
def _session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def available_now(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Process what is there, then stop; run again to go on from there.

    Returns the finished query; a failure is raised. ``state_partitions`` fixes
    the number of state partitions when the checkpoint is new.
    """
    spark = df.sparkSession
    settings = dict(_STATE_STORE)
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    # A started query works on its own copy of the settings.
    with _session_settings(spark, settings):
        writer = df.writeStream.outputMode("append").foreachBatch(write)
        writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.start()
    query.awaitTermination()
    return query
