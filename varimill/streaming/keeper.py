"""Bars of a tick stream, kept so that every tick is accounted for.

Each micro-batch is plain batch work on two small tables: the open bars of the batch
before, and a ledger entry with how far time has come. Ticks are aggregated to partial
bars at once, merged with the open ones, and split by the new mark: bars that end
before it are closed for good, the others stay open. A valid tick of a closed bar is
late and becomes a row of its own table, from which the bars can still be corrected,
as closed bars stay mergeable. The ledger entry is written last: a repeated batch that
is in the ledger is skipped, one that is not overwrites what it had left.

The mark is the newest time less the delay. Time may be moved by valid ticks only or
by all of them (``moved_by``), and may be kept per source: the mark is then that of
the source that is furthest behind, so sources may run at their own pace. Sources that
are expected but have not sent a tick hold the mark back. A mark acts from the next
micro-batch on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.config import PipelineConfig
from varimill.functions import millis
from varimill.ledger import commit, entries, entries_of, run_path
from varimill.operators.bars import merged_bars, merged_partials, partial_bars
from varimill.operators.ticks import VALID
from varimill.schemas import PARTIAL_BAR, TICK

_DEFAULT = PipelineConfig()
_VALID = " AND ".join(f"({ok})" for ok in VALID.values())
# How far a source has come.
_NEWEST = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("ts", T.LongType())]))
BATCH_ENTRY = T.StructType(
    [
        T.StructField("ticks", T.LongType()),
        T.StructField("valid", T.LongType()),
        T.StructField("late", T.LongType()),
        T.StructField("mark", T.LongType()),
        T.StructField("newest", _NEWEST),
    ]
)
_KEPT = T.StructType([*PARTIAL_BAR.fields, T.StructField("closed", T.BooleanType())])


def _bars_at(root: str) -> str:
    return f"{root}/bars"


def _late_at(root: str) -> str:
    return f"{root}/late"


def keep_bars(
    root: str,
    config: PipelineConfig = _DEFAULT,
    source: str | None = None,
    expected: Sequence[str] = (),
    moved_by: str = "valid",
) -> Callable[[DataFrame, int], None]:
    """Batch writer of a tick stream to bars and late ticks below ``root``.

    ``source`` is a SQL expression that names a tick's source; ``expected`` sources
    hold the mark until they have sent something. ``moved_by`` is ``valid`` or ``all``.
    """
    if moved_by not in ("valid", "all"):
        raise ValueError("moved_by is 'valid' or 'all'")
    span, delay = millis(config.bar_width), millis(config.watermark)
    bar_end = f"ts - pmod(ts, {span}L) + {span}L"
    moves = _VALID if moved_by == "valid" else "ts IS NOT NULL"
    name = source or "''"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, batch_id + 1
        if entries_of(spark, root, run, BATCH_ENTRY) is not None:
            return
        # Ids of a stream follow each other.
        before = entries_of(spark, root, run - 1, BATCH_ENTRY)
        last = before.first() if before is not None else None
        mark = last["mark"] if last else None
        newest = {n["source"]: n["ts"] for n in last["newest"]} if last else {}
        rows = batch.select(*TICK.names, F.expr(name).alias("source")).persist()
        try:
            seen = rows.groupBy("source").agg(
                F.count("*").alias("ticks"),
                F.expr(f"count_if({_VALID})").alias("valid"),
                F.expr(f"max(ts) FILTER (WHERE {moves})").alias("newest"),
            )
            # A row per source.
            seen = seen.collect()
            for r in seen:
                if r["newest"] is not None:
                    newest[r["source"]] = max(r["newest"], newest.get(r["source"], r["newest"]))
            is_late = f"{_VALID} AND {bar_end} <= {mark}L" if mark is not None else "false"
            late = rows.where(is_late).select(*TICK.names)
            late.write.mode("overwrite").parquet(run_path(_late_at(root), run))
            on_time = rows.where(f"{_VALID} AND NOT ({is_late})")
            kept = partial_bars(on_time, config.bar_width)
            if last:
                kept = merged_partials(kept.unionByName(_kept(spark, root, run - 1, False)))
            waiting = [s for s in expected if s not in newest]
            times = list(newest.values())
            following = min(times) - delay if times and not waiting else None
            if following is not None and mark is not None:
                following = max(following, mark)  # a source that turns up late does not move it back
            following = mark if following is None else following
            closed = F.lit(False) if following is None else F.col("bar_end") <= following
            kept.withColumn("closed", closed).write.mode("overwrite").partitionBy("closed").parquet(
                run_path(_bars_at(root), run)
            )
        finally:
            rows.unpersist()
        n_late = spark.read.schema(TICK).parquet(run_path(_late_at(root), run)).count()
        entry = (
            str(batch_id),
            sum(r["ticks"] for r in seen),
            sum(r["ticks"] for r in seen),
            sum(r["valid"] for r in seen),
            n_late,
            following,
            sorted(newest.items()),
        )
        schema = T.StructType(
            [T.StructField("key", T.StringType()), T.StructField("rows", T.LongType()), *BATCH_ENTRY.fields]
        )
        commit(spark.createDataFrame([entry], schema), root, run)

    return write


def _kept(spark: SparkSession, root: str, run: int, closed: bool) -> DataFrame:
    rows = spark.read.schema(_KEPT).parquet(run_path(_bars_at(root), run))
    return rows.where(F.col("closed") == closed).select(*PARTIAL_BAR.names)


def batch_counts(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id``, ``ticks``, ``valid``, ``late``, ``mark`` of every micro-batch, each
    once however often it was run."""
    rows = entries(spark, root, BATCH_ENTRY)
    return rows.select((F.col("run_id") - 1).alias("batch_id"), "ticks", "valid", "late", "mark")


def _runs(spark: SparkSession, root: str) -> list[int]:
    return sorted(r["run_id"] for r in entries(spark, root, BATCH_ENTRY).select("run_id").collect())


def kept_partials(spark: SparkSession, root: str, still_open: bool = False) -> DataFrame:
    """All closed bars as partial ones; with ``still_open`` also the open ones."""
    runs = _runs(spark, root)
    if not runs:
        return spark.createDataFrame([], PARTIAL_BAR)
    rows = spark.read.schema(T.StructType([*_KEPT.fields, T.StructField("run_id", T.LongType())]))
    rows = rows.option("basePath", _bars_at(root)).parquet(*(run_path(_bars_at(root), r) for r in runs))
    wanted = F.col("closed") | (F.lit(still_open) & (F.col("run_id") == runs[-1]))
    return rows.where(wanted).select(*PARTIAL_BAR.names)


def kept_bars(
    spark: SparkSession, root: str, still_open: bool = False, config: PipelineConfig = _DEFAULT
) -> DataFrame:
    """The bars of ``log_return_bars`` that are closed; with ``still_open`` all."""
    return merged_bars(kept_partials(spark, root, still_open), config.min_ticks)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Valid ticks that came after their bar was closed."""
    runs = _runs(spark, root)
    if not runs:
        return spark.createDataFrame([], TICK)
    return spark.read.schema(TICK).parquet(*(run_path(_late_at(root), r) for r in runs))


def corrected_bars(
    spark: SparkSession, root: str, still_open: bool = False, config: PipelineConfig = _DEFAULT
) -> DataFrame:
    """The kept bars with their late ticks, as if all had come in time."""
    late = partial_bars(late_rows(spark, root), config.bar_width)
    return merged_bars(kept_partials(spark, root, still_open).unionByName(late), config.min_ticks)
