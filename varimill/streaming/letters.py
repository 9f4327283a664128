"""Dead letters as a stream, so that each is replayed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varimill.operators.replay import replay
from varimill.operators.scoring import split_scored
from varimill.schemas import STORED
from varimill.sinks.outcomes import REPLAY, write_scored


def dead_letter_stream(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters of the forecast batches stored below ``root``, old and new.

    What replays store there is left out. With a checkpoint, a batch of letters is
    done when its replay is stored.
    """
    stored = spark.readStream.schema(STORED).parquet(root)
    stored = stored.where(f"outcome = 'dead_letter' AND NOT startswith(batch_id, '{REPLAY}')")
    return split_scored(stored)[1]


def replay_batches(
    root: str, run: str, scorer=None, sink_partitions: int | None = None, **options
) -> Callable[[DataFrame, int], None]:
    """Batch writer that replays letters and stores the outcomes below ``root``,
    under names made of ``run``, which tells one series of replays from another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        outcomes = replay(batch, scorer, **options)
        write_scored(outcomes, f"{REPLAY}{run}-{batch_id}", root, sink_partitions)

    return write
