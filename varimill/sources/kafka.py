"""Ticks and dead letters on Kafka topics.

Needs the Kafka and Avro packages of Spark on the class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varimill.schemas import MATRIX, TICK, TICK_AVRO

# Fixed values of the wire format.
TICK_TOPIC = "ticks"
DEAD_LETTER_TOPIC = "ml-failed"
# A registry-framed Avro value starts with a zero byte and a 4-byte schema id.
REGISTRY_HEADER_BYTES = 5


def kafka_options(servers: str, topic: str, streaming: bool) -> dict[str, str]:
    """Read a topic from its start to the offsets it has when the read begins.

    On a stream the end comes from ``trigger(availableNow=True)``.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    return options if streaming else options | {"endingOffsets": "latest"}


def _read(spark: SparkSession, servers: str, topic: str, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**kafka_options(servers, topic, streaming)).load()


def ticks_from_records(records: DataFrame, schema: str = TICK_AVRO) -> DataFrame:
    """Ticks from Kafka records; the key is ignored, the offset breaks ties.

    Ticks of one symbol share a partition, so their offsets are comparable.
    """
    from pyspark.sql.avro.functions import from_avro

    body = F.expr(f"substring(value, {REGISTRY_HEADER_BYTES + 1})")
    tick = from_avro(body, schema)
    return (
        records.select(tick.alias("tick"), F.col("offset").alias("seq"))
        .select("tick.*", "seq")
        .withColumnRenamed("timestamp", "ts")
        .select(*TICK.names)
    )


def read_ticks_kafka(
    spark: SparkSession, servers: str, topic: str = TICK_TOPIC, streaming: bool = True
) -> DataFrame:
    return ticks_from_records(_read(spark, servers, topic, streaming))


def dead_letters_from_records(records: DataFrame) -> DataFrame:
    """Dead letters from Kafka records: key is the symbol, value the request."""
    return records.select(
        F.col("key").cast("string").alias("symbol"),
        F.lit(None).cast("long").alias("ts"),
        F.col("value").cast("string").alias("payload"),
        F.lit(None).cast(MATRIX).alias("sequence"),
        F.lit(None).cast("string").alias("reason"),
    )


def read_dead_letters_kafka(
    spark: SparkSession, servers: str, topic: str = DEAD_LETTER_TOPIC, streaming: bool = False
) -> DataFrame:
    return dead_letters_from_records(_read(spark, servers, topic, streaming))
