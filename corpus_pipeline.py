"""From raw documents to encoded training text, in five stages.

Each stage is a function of (spark, documents, folder of the tables) to the
documents it keeps; what one writes as Parquet the next reads.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import varimill
from varimill.llm import decontaminate, jaccard_join, pieces, quality_model, secrets
from varimill.llm.frames import sheltered, small_batches
from varimill.sources.tables import read_table
from varimill.workspace import run_dir

# Executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(varimill)

# Stages that SQL cannot express are tested against a brute-force version.
ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject."""
    small_batches(spark)
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")

    def work(rows: DataFrame) -> DataFrame:
        return quality_model.classify(rows, trusted, keep_text=True).where("kept")

    return sheltered(docs, quality_model.TAKEN, work)


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies link."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    small_batches(spark)
    items = read_table(spark, sf_dir, "benchmark")

    def work(rows: DataFrame) -> DataFrame:
        return decontaminate.with_leaks(rows, items).where(F.size("leaks") == 0)

    return sheltered(docs, ("leaks",), work)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in the text."""
    small_batches(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and whether decoding gives the text back."""
    small_batches(spark)
    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.withColumn("round_trip", same).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_different),
    ("benchmark decontamination", keep_unleaked),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = run_dir(spark, f"stage-{number}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
