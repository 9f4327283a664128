"""Session settings the pipeline is meant to run with."""

from __future__ import annotations

# Set when the session is built; a cluster adds its own sizes.
RECOMMENDED = {
    # Times are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Coalesces the small shuffles of bars and days, splits skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # Building a plan in Python without recording the caller of every expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A rewritten batch must not leave rows of its earlier attempt behind.
    "spark.sql.sources.partitionOverwriteMode": "static",
    # Stream state beyond executor memory, with incremental checkpoints.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
