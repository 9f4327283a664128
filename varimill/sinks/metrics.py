"""Run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.operators.reports import with_throughput
from varimill.schemas import RUN_METRICS


def append_metrics(runs: DataFrame, path: str) -> None:
    """Append run rows as CSV with a header; computes the throughput column."""
    rows = with_throughput(runs).withColumn(
        "throughput_ticks_per_sec", F.round("throughput_ticks_per_sec", 2)
    )
    rows.select(*RUN_METRICS.names).write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run rows, also from files whose throughput has a decimal comma.

    Such a file splits the last number over two fields, one more than its header
    has; they are joined again.
    """
    fraction = T.StructField("fraction", T.StringType())
    text = T.StructType([T.StructField(n, T.StringType()) for n in RUN_METRICS.names] + [fraction])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", True).csv(path)
    last = RUN_METRICS.names[-1]
    joined = F.concat_ws(".", F.col(last), F.col("fraction"))
    typed = rows.withColumn(last, joined)
    return typed.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RUN_METRICS))
