"""Harmonic packing of documents into token sequences of a fixed capacity.

Lengths are partitioned into classes by the reciprocals of the capacity C: class k
holds pieces of C // k tokens, and each of its sequences takes exactly k of them, so a
class fills its sequences by counting, without a search for room. As documents may be
cut, a document's ids are cut into such pieces, the largest that fits first: full
sequences, and at most a few pieces of the rest (the rest after a piece of class k is
less than a (k + 1)-th of it). A full sequence of class k is padded by C - k (C // k)
tokens, which is less than k.

Every task fills its own sequences; no row is shuffled and no task waits for another.
What a task has left at its end, fewer than k pieces of each class, is laid end to end
and cut at the capacity and then at powers of two, at which sequences need no padding;
so tables of any size and any number of tasks are packed equally tight.

Sequence ids are the number of the task and a count in it: unique within one
evaluation of the frame, the same when a task is run again on the same split of the
input. Store the result before it is used twice.

A null text is empty; an empty text is its end id alone. Null and repeated document
ids stand as they are: pieces of rows with the same id are told apart by their place
in the output only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.byte_pairs import PairSpec, byte_pairs
from varimill.llm.frames import arrow_schema, give_back
from varimill.llm.words import chunks

CAPACITY = 1024
TASK_BITS = 40  # of a sequence id count the sequences of a task
_ROWS = 20_000  # pieces of an Arrow batch that is handed on


def harmonic_classes(length: int, capacity: int) -> list[int]:
    """The classes of the pieces a length below the capacity is cut into."""
    classes = []
    while length:
        classes.append(capacity // (length + 1) + 1)
        length -= capacity // classes[-1]
    return classes


class _Packer:
    """Fills the sequences of one task."""

    def __init__(self, task: int, capacity: int) -> None:
        self.capacity = capacity
        self.next_id = task << TASK_BITS
        self.classes = [harmonic_classes(n, capacity) for n in range(capacity)]
        # By class: the pieces (document, start, ids, tokens of the document) that wait.
        self.waiting: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next_id, at
            at += len(ids)
        self.next_id += 1

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        """The pieces of all sequences that a document fills."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            yield from self._sequence([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        for k in self.classes[total - at]:
            size = self.capacity // k
            waiting = self.waiting.setdefault(k, [])
            # A copy, so that a piece that waits does not keep its whole document.
            waiting.append((doc, at, ids[at : at + size].copy(), total))
            at += size
            if len(waiting) == k:
                yield from self._sequence(self.waiting.pop(k))

    def rest(self) -> Iterator[tuple]:
        """What waits, laid end to end and cut where sequences need no padding."""
        left = [p for k in sorted(self.waiting) for p in self.waiting.pop(k)]
        total = sum(len(ids) for _, _, ids, _ in left)
        sizes = [self.capacity] * (total // self.capacity)
        short = total % self.capacity
        sizes += [1 << b for b in reversed(range(short.bit_length())) if short >> b & 1]
        left.reverse()
        for size in sizes:
            taken = []
            while size:
                doc, start, ids, n = left.pop()
                taken.append((doc, start, ids[:size], n))
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], n))
                size -= len(taken[-1][2])
            yield from self._sequence(taken)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row per piece: the document's id, ``start`` (its ids before the piece),
    ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id`` and ``offset`` (place in the sequence).

    ``tokenizer_path`` names a tokenizer's JSON file, read in the driver. A document's
    ids are the tokenizer's, without special tokens, and ``end_id``.
    """
    spec = docs.sparkSession.sparkContext.broadcast(PairSpec.load(tokenizer_path))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    out = arrow_schema(schema)
    end = np.array([end_id], "<u4")

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        encode, made = byte_pairs(spec.value).encode, []
        for rows in batches:
            names = rows.column(0).to_pylist()
            for low, high, _, _ in chunks(rows.column(1)):
                for doc, content in zip(names[low:high], rows.column(1)[low:high].to_pylist(), strict=True):
                    for piece in packer.add(doc, np.concatenate([encode(content), end])):
                        made.append(piece)
                        if len(made) == _ROWS:
                            yield batch(made)
                            made = []
        made += packer.rest()
        if made:
            yield batch(made)
        del made, packer
        give_back()

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)


def padded_length(length: Column, capacity: int = CAPACITY) -> Column:
    """A sequence's length with padding: the capacity, but none at a power of two."""
    return F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(F.lit(capacity).cast("long"))


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids``, ``length``, ``padded``, and
    ``piece_offsets``, the places at which attention may be cut.

    A sequence has at most ``capacity`` ids, however many documents there are.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(
        ordered.alias("p"), F.sum("length").alias("length")
    )
    return grouped.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        "length",
        padded_length(F.col("length"), capacity).alias("padded"),
        F.transform("p", lambda x: x["offset"]).alias("piece_offsets"),
    )


def padding_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding tokens, and pieces over all."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("n"))
    padding = padded_length(F.col("length"), capacity) - F.col("length")
    return filled.agg(
        F.count("*").alias("n_sequences"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(padding), F.lit(0)).alias("n_padding"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"),
    )
