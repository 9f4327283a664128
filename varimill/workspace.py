"""Where intermediate tables and checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    ``spark.checkpoint.dir`` first, then a folder given to
    ``SparkContext.setCheckpointDir``. Only a session whose executors run on the
    driver's machine, such as a test, gets a local one; on a cluster without
    either this raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    given = given or context.getCheckpointDir()
    if given:
        return given
    if context.master.startswith("local["):
        return f"{tempfile.gettempdir()}/varimill"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder for one run."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
