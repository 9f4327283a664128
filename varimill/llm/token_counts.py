"""Exact token totals for every context limit from one histogram.

Documents are aggregated by encoded length; all answers are sums over the
histogram, whose size is bounded by the longest document, not by the corpus.
Suffix sums are taken in blocks of lengths, so no task sees the whole histogram.

Null texts count as empty, with zero tokens.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import map_arrays, process_cache, stored
from varimill.llm.words import chunks

BLOCK = 1024  # lengths per block of suffix sums


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, the length of each text under a byte-pair vocabulary.

    ``ranks_path`` names a file of base64 tokens and ranks, read in the driver.
    """
    with open(ranks_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def make(column: pa.Array) -> list[pa.Array]:
        cache = process_cache("encodings")
        if ranks_path not in cache:
            import tiktoken

            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.value.splitlines())}
            cache[ranks_path] = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
        encode = cache[ranks_path].encode_ordinary
        counts: list[int] = []
        for low, high, _, _ in chunks(column):
            counts += [len(encode(x)) if x else 0 for x in column[low:high].to_pylist()]
        return [pa.array(counts, pa.int64())]

    return map_arrays(docs, [text], [T.StructField("n_tokens", T.LongType())], make)


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limit_report(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, what a context limit of L means.

    ``docs_longer`` and ``docs_within``; ``rank``: the quantile L is, the share
    of documents of at most L tokens; ``tokens_within``: tokens of these;
    ``tokens_truncated``: tokens left when every document is cut at L;
    ``tokens_lost``: those cut off. A limit between two lengths has the counts of
    the lower one and ``tokens_truncated`` larger by ``docs_longer`` a token.
    """
    histogram = stored(histogram, "lengths")  # read by several branches; texts are encoded once
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = histogram.withColumn("tokens", tokens).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    everything = blocks.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    blocks = blocks.select(
        F.col("block").alias("of_block"),
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")
    tokens_longer = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_after")
    # One row of totals by its making.
    joined = rows.join(blocks, F.col("block") == F.col("of_block")).crossJoin(everything)
    joined = joined.withColumn("docs_longer", longer).withColumn("tokens_longer", tokens_longer)
    within = F.col("all_tokens") - F.col("tokens_longer")
    truncated = within + F.col("n_tokens") * F.col("docs_longer")
    return joined.select(
        F.col("n_tokens").alias("token_limit"),
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("rank"),
        within.alias("tokens_within"),
        truncated.alias("tokens_truncated"),
        (F.col("all_tokens") - truncated).alias("tokens_lost"),
    )


def length_quantile(report: DataFrame, q: float) -> DataFrame:
    """The exact ``q`` quantile: the least length that ``q`` of the documents do not exceed."""
    return report.where(F.col("rank") >= q).agg(F.min("token_limit").alias("token_limit"))
