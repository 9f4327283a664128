"""Predictions and dead letters.

One write per batch holds both, so the scorer runs once and each request ends
on exactly one side. A batch has its own directory and overwrites only that:
running it again after a failure leaves no duplicate. Replays write batches of
their own names below the same root, so they never meet a forecast batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.ledger import finished_paths, path_exists, remove_path
from varimill.operators.scoring import INVALID, OK, split_scored
from varimill.schemas import PREDICTION, PREDICTION_ROW, STORED, SYMBOL_MAX_CHARS
from varimill.sources.kafka import DEAD_LETTER_TOPIC

REPLAY = "replay-"
COMPACTED = "compacted-"


def _fits_table() -> Column:
    """What the predictions table demands of a row."""
    required = [f.name for f in PREDICTION.fields if not f.nullable]
    present = " AND ".join(f"{name} IS NOT NULL" for name in required)
    return F.expr(f"{present} AND char_length(symbol) <= {SYMBOL_MAX_CHARS}")


def outcomes(scored: DataFrame) -> DataFrame:
    """Scored rows with ``outcome``, prediction or dead letter, and ``created_at``.

    A prediction that the predictions table could not hold (a required column without
    value, a symbol too long) becomes an invalid dead letter here, before it is stored.
    """
    good = F.col("status") == OK
    fits = F.coalesce(_fits_table(), F.lit(False))
    rows = scored.withColumn("status", F.when(good & ~fits, F.lit(INVALID)).otherwise(F.col("status")))
    outcome = F.when(good, F.lit("prediction")).otherwise(F.lit("dead_letter"))
    return rows.withColumn("outcome", outcome).withColumn("created_at", F.current_timestamp())


def write_scored(
    scored: DataFrame, batch_id: int | str, root: str, partitions: int | None = None
) -> None:
    """Write one scored batch below ``root``, predictions and dead letters apart.

    ``partitions`` sets the number of writers. The shuffle it takes is by key, so
    scoring keeps its own parallelism and a rerun task cannot move a row to a second
    writer.
    """
    rows = outcomes(scored)
    if partitions is not None:
        rows = rows.repartition(partitions, "symbol", "ts")
    rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/batch_id={batch_id}")


def _stored_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of finished batches; a batch that is being written, or whose write was
    cut off, does not show."""
    paths = finished_paths(spark, f"{root}/batch_id=*")
    if not paths:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", root).parquet(*paths)


def _read_outcome(spark: SparkSession, root: str, outcome: str) -> DataFrame:
    return _stored_rows(spark, root).where(F.col("outcome") == outcome)


def _replayed() -> Column:
    """Rows that a replay has made; compacted ones still name their letter."""
    return F.startswith(F.col("batch_id"), F.lit(REPLAY)) | F.col("letter_ts").isNotNull()


def _newest(rows: DataFrame) -> DataFrame:
    """Of several rows for the same symbol and ``ts`` the newest, with all columns."""
    others = [c for c in rows.columns if c not in ("symbol", "ts")]
    picked = F.max_by(F.struct(*others), F.struct("created_at", "batch_id"))
    return rows.groupBy("symbol", "ts").agg(picked.alias("r")).select("symbol", "ts", "r.*")


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """All predictions stored below ``root``, those of replays too, as rows of the
    predictions table. Of several for the same symbol and ``ts`` the newest counts,
    found by an aggregate that works before the shuffle.
    """
    rows = _read_outcome(spark, root, "prediction")
    # One long, so that the aggregate is by hash; columns that go by the same age come
    # from the same row.
    age = "unix_micros(created_at) * 1024 + pmod(xxhash64(batch_id), 1024)"
    names = [c for c in PREDICTION_ROW.names[1:] if c not in ("symbol", "ts")]
    rows = rows.selectExpr("symbol", "ts", *names, f"{age} AS _age")
    newest = rows.groupBy("symbol", "ts").agg(*(F.max_by(c, "_age").alias(c) for c in names))
    return newest.select(_row_id(), *PREDICTION_ROW.names[1:])


def compact_predictions(spark: SparkSession, root: str) -> str | None:
    """Put the predictions that count into one batch and drop those they replace; gives
    the batch, None if there is nothing to gain.

    The new batch is complete before any old one goes, and rows of both are the same to
    a reader. Letters stay where they are, for the replays that follow them. For a time
    when no batch is being written.
    """
    held = [p for p in finished_paths(spark, f"{root}/batch_id=*") if path_exists(spark, f"{p}/outcome=prediction")]
    if len(held) < 2:
        return None
    rows = _read_outcome(spark, root, "prediction")
    # Replays of the same prediction: the letter they settle is kept with any of them.
    letter = F.when(_replayed(), F.coalesce("letter_ts", "ts"))
    rows = rows.withColumn("letter_ts", letter)
    settled = rows.where("letter_ts IS NOT NULL").groupBy("symbol", "ts").agg(F.max("letter_ts").alias("letter_ts"))
    kept = _newest(rows.drop("letter_ts")).join(settled, ["symbol", "ts"], "left")
    name = f"{COMPACTED}{uuid.uuid4().hex}"
    names = [c for c in STORED.names if c not in ("batch_id", "outcome")]
    made = kept.withColumn("outcome", F.lit("prediction")).select(*names, "outcome")
    made.write.mode("error").partitionBy("outcome").parquet(f"{root}/batch_id={name}")
    for path in held:
        remove_path(spark, f"{path}/outcome=prediction")
    return name


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Letters of the forecast batches that no replay has turned into a prediction."""
    letters = _read_outcome(spark, root, "dead_letter").where(~_replayed())
    settled = _read_outcome(spark, root, "prediction").where(_replayed())
    settled = settled.select(
        F.col("symbol").alias("s_symbol"), F.coalesce("letter_ts", "ts").alias("s_ts")
    )
    same = F.col("symbol").eqNullSafe(F.col("s_symbol")) & F.col("ts").eqNullSafe(F.col("s_ts"))
    return split_scored(letters.join(settled, same, "left_anti"))[1]


def _row_id() -> Column:
    return F.xxhash64("symbol", "ts").alias("id")


def _required(field: T.StructField) -> Column:
    value = F.col(field.name)
    if field.nullable:
        return value
    message = F.lit(f"null in required column {field.name}")
    return F.coalesce(value, F.raise_error(message).cast(field.dataType)).alias(field.name)


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Rows that satisfy the table definition; one that cannot stops the job.

    The surrogate id is a hash of (symbol, ts): the same prediction has the same
    id in every run, without a counter to coordinate.
    """
    if "created_at" not in predictions.columns:
        predictions = predictions.withColumn("created_at", F.current_timestamp())
    fits = F.char_length("symbol") <= SYMBOL_MAX_CHARS
    long_symbol = F.raise_error(F.lit(f"symbol longer than {SYMBOL_MAX_CHARS} characters"))
    rows = predictions.select(*(_required(f) for f in PREDICTION.fields), "created_at")
    return rows.withColumn(
        "symbol", F.when(fits, F.col("symbol")).otherwise(long_symbol.cast("string"))
    ).select(_row_id(), *PREDICTION_ROW.names[1:])


def write_predictions_jdbc(
    predictions: DataFrame,
    url: str,
    table: str = "predictions",
    partitions: int = 4,
    since_ts: int | None = None,
    properties: dict[str, str] | None = None,
) -> None:
    """Append to a relational table over at most ``partitions`` connections.

    Rows whose symbol and ``ts`` are already there are left out, so a batch that
    failed half way can run again. Only keys are read back, over as many
    connections, from ``since_ts`` on; by default from the earliest of the batch.
    """
    rows = prediction_rows(predictions)
    earliest, latest = rows.agg(F.min("ts"), F.max("ts")).first()
    if latest is None:
        return
    since = earliest if since_ts is None else since_ts
    reader = predictions.sparkSession.read.options(**(properties or {}))
    present = reader.jdbc(
        url,
        f"(SELECT symbol, ts FROM {table} WHERE ts >= {int(since)}) AS present",
        column="ts",
        lowerBound=int(since),
        upperBound=max(int(latest), int(since) + 1),
        numPartitions=partitions,
    )
    rows = rows.join(present, ["symbol", "ts"], "left_anti").select(*PREDICTION_ROW.names)
    writer = rows.write.mode("append").option("numPartitions", partitions)
    writer.options(**(properties or {})).jdbc(url, table)


def write_dead_letters_kafka(
    letters: DataFrame, servers: str, topic: str = DEAD_LETTER_TOPIC
) -> None:
    records = letters.select(
        F.col("symbol").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value")
    )
    writer = records.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).save()
