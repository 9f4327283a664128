"""Tables whose parts are replaced as a whole, by a ledger of what counts.

A part is all a table holds under one key, such as a daily file or a day. Runs are
numbered. A run writes its parts to a directory of its own, then one ledger file with an
entry for every key it has settled, keys without rows included. The newest entry of a
key says where its rows are, so a part that shrinks or becomes empty leaves nothing
behind, and a run that stops before its ledger file is written changes nothing: the
next run takes the same number and overwrites its rows.

A ledger has a row per key and run. It answers which keys there are and what they hold
without a look at the rows. Two runs at a time on one table are not meant to be; the
second to commit a number fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEDGER = "_ledger"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def finished_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The directories that match and that a finished write has left: what a write that
    was cut off leaves has no mark of success."""
    system, target = _file_system(spark, f"{pattern}/_SUCCESS")
    found = system.globStatus(target) or []
    return sorted(s.getPath().getParent().toString() for s in found)


def remove_path(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def has_ledger(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, f"{root}/{_LEDGER}")


def entries(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All entries ever committed: ``run_id``, ``key``, ``rows`` and the columns of
    ``schema``."""
    full = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("rows", T.LongType()), *schema.fields]
    )
    if not has_ledger(spark, root):
        return spark.createDataFrame([], T.StructType([T.StructField("run_id", T.LongType()), *full.fields]))
    read = T.StructType([*full.fields, T.StructField("run_id", T.LongType())])
    return spark.read.schema(read).parquet(f"{root}/{_LEDGER}").select("run_id", *full.names)


def current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest entry of every key."""
    rows = entries(spark, root, schema)
    newest = rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "run_id").alias("e"))
    return newest.select("e.*")


def entries_of(spark: SparkSession, root: str, run_id: int, schema: T.StructType) -> DataFrame | None:
    """The entries of one run, None if it is not committed; no other run is looked at."""
    path = f"{root}/{_LEDGER}/run_id={run_id}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    full = [T.StructField("key", T.StringType()), T.StructField("rows", T.LongType()), *schema.fields]
    return spark.read.schema(T.StructType(full)).parquet(path).withColumn("run_id", F.lit(run_id).cast("long"))


def next_run(spark: SparkSession, root: str) -> int:
    """The number after the last one committed."""
    if not has_ledger(spark, root):
        return 1
    system, target = _file_system(spark, f"{root}/{_LEDGER}")
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return 1 + max((int(n.split("=")[1]) for n in names if n.startswith("run_id=")), default=0)


def _part(key: Column | str) -> Column:
    # A digest needs no escaping in a path.
    return F.md5(key).alias("part")


def run_path(root: str, run_id: int) -> str:
    return f"{root}/run_id={run_id}"


def write_parts(rows: DataFrame, root: str, run_id: int, key: str, by: Sequence[str] = ()) -> None:
    """The rows of a run, one directory per key and value of ``by``."""
    writer = rows.withColumn("part", _part(key)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "static").partitionBy("part", *by).parquet(run_path(root, run_id))


def read_run(spark: SparkSession, root: str, run_id: int, schema: T.StructType) -> DataFrame:
    """What a run has written, committed or not."""
    return spark.read.schema(schema).parquet(run_path(root, run_id)).select(*schema.names)


def commit(settled: DataFrame, root: str, run_id: int) -> None:
    """Let a run count. ``settled`` has a row per key with ``key`` and ``rows``.

    It is small, a row per key, and one file, which appears at once or not at all.
    """
    settled.coalesce(1).write.mode("error").parquet(f"{root}/{_LEDGER}/run_id={run_id}")


def read_parts(
    spark: SparkSession, root: str, schema: T.StructType, chosen: DataFrame | None = None
) -> DataFrame:
    """The rows that count, of the entries in ``chosen`` (``run_id``, ``key``, ``rows``),
    by default of all newest ones. Only their directories are listed."""
    if chosen is None:
        chosen = current(spark, root, T.StructType([]))
    parts = chosen.where("rows > 0").select("run_id", _part("key")).distinct().collect()
    if not parts:
        return spark.createDataFrame([], schema)
    paths = [f"{run_path(root, r['run_id'])}/part={r['part']}" for r in sorted(parts)]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*schema.names)


def remove_superseded(spark: SparkSession, root: str) -> int:
    """Delete the parts that newer entries have replaced; gives their number.

    For a time when nobody reads an older state of the table.
    """
    rows = entries(spark, root, T.StructType([]))
    newest = rows.groupBy(F.col("key").alias("k")).agg(F.max("run_id").alias("r"))
    old = rows.join(newest, (F.col("key") == F.col("k")) & (F.col("run_id") < F.col("r"))).where("rows > 0")
    removed = 0
    # One row per replaced part.
    for r in old.select("run_id", _part("key")).toLocalIterator():
        path = f"{run_path(root, r['run_id'])}/part={r['part']}"
        if path_exists(spark, path):
            remove_path(spark, path)
            removed += 1
    return removed
