"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from varimill.workspace import run_dir

FILTER_BITS = 25  # of a key filter: at most 2^19 rows of 12 bytes


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def small_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 512) -> None:
    """Let Spark move documents in batches of few bytes.

    Texts go to Python in batches of ``size`` bytes, not of ten thousand rows, and are
    read from Parquet ``rows`` at a time: a buffer for thousands of texts is megabytes
    large, and is copied each time it grows. Settings of the session; results do not
    depend on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = run_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this Python process has freed to the machine.

    Workers outlive their tasks; what their allocators keep would add up beside the
    next stage's.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # an allocator that knows no such call
        pass


def map_arrays(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[..., list[pa.Array]],
) -> DataFrame:
    """Add columns that ``make`` computes from Arrow arrays of ``inputs``.

    All other columns pass through; one with the name of a new column is replaced.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new or f.name in inputs]
    schema = T.StructType([f for f in kept if f.name not in new] + fields)
    out = arrow_schema(schema)
    passed = [f.name for f in kept if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(batch.column(c) for c in inputs))
            arrays = [batch.column(c) for c in passed] + made
            arrays = [a.cast(t.type) for a, t in zip(arrays, out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)
            # Nothing of a batch is held while the next one is waited for.
            del batch, made, arrays
            give_back()

    return df.select(*(f.name for f in kept)).mapInArrow(run, schema)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python process, across tasks."""
    holder = sys.modules.setdefault("_varimill_process", types.ModuleType("_varimill_process"))
    return holder.__dict__.setdefault(name, {})


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for columns that have one of ``names``, whatever the
    case, and the old name of each new one."""
    taken = {n.lower() for n in names}
    back: dict[str, str] = {}
    for column in docs.columns:
        if column.lower() in taken:
            back[unused(f"_{column}", [*docs.columns, *names, *back])] = column
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def sheltered(
    docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``work`` on ``docs`` while columns with one of ``names`` go by other names;
    gives the columns of ``docs`` back."""
    aside: dict[str, str] = {}
    for column in docs.columns:
        if column.lower() in names:
            aside[column] = unused(f"_{column}", [*docs.columns, *aside.values()])
    back = {new: old for old, new in aside.items()}
    made = work(docs.withColumnsRenamed(aside)).select(*(aside.get(c, c) for c in docs.columns))
    return made.withColumnsRenamed(back)


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A one-hash Bloom filter of a key column, of fixed size whatever the keys."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    return (
        keys.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("filter_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("filter_bits"))
    )


def maybe_in(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose key may be in the filter; all rows whose key is in it.

    The filter has at most 2^19 rows by its making, so it may be broadcast. It
    saves shuffling rows; the caller still joins on the key.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    joined = df.join(F.broadcast(bits), F.shiftright(bit, 6) == F.col("filter_word"))
    hit = F.expr(f"(shiftright(filter_bits, cast(pmod(xxhash64(`{column}`), {1 << FILTER_BITS}) & 63 AS int)) & 1) = 1")
    return joined.where(hit).drop("filter_word", "filter_bits")
