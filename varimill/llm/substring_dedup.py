"""Removal of passages that a document with a smaller id has already.

A window of 13 words that also starts in a document with a smaller id is a
repeat, and its words go. Repeats are found by fixed blocks: every document's
non-overlapping blocks of 7 words, at places 0, 7, 14, ..., are the index, and
every rolling run of 7 words probes it. Any 13 words of the earlier document
hold a whole block, so no repeat is missed. Hits, and the blocks they hit, are
extended to all windows around them, which meet on the hash of their 13 words;
chains of equal windows are the maximal exact repeats.

What is shuffled is packed: per batch of documents and hash bucket, 32 bits of
the hash and one byte of place for each run, and texts compressed once. No
window is compared with another outside its bucket, and a frequent passage costs
its bucket one entry per occurrence, never a pair.

Null texts have no words. A row without id is neither cut nor a reference for
others. Rows with the same id do not count as smaller than each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import arrow_schema
from varimill.llm.words import Words, chunks, mix, texts

WINDOW = 13
BATCH_BYTES = 6 << 20
_FIRST = np.uint64(32)


def _schema(key: str, more: list[tuple[str, T.DataType]] = ()) -> T.StructType:
    packed = [(n, T.BinaryType()) for n in ("docs", "subs", "counts", "gaps", "wide", "hashes")]
    return T.StructType([T.StructField(n, t) for n, t in [(key, T.IntegerType()), *packed, *more]])


def _pack(doc: np.ndarray, sub: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """Entries in order of document and place as bytes: about one per place."""
    starts = np.flatnonzero(
        np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
    )
    gaps = np.diff(place, prepend=0)
    gaps[starts] = place[starts]
    wide = gaps > 254
    narrow = np.where(wide, 255, gaps).astype(np.uint8)
    counts = np.diff(np.append(starts, len(doc))).astype("<u4")
    arrays = (doc[starts], sub[starts].astype("<u4"), counts, narrow, gaps[wide].astype("<u4"), hashes)
    return [a.tobytes() for a in arrays]


def _unpack(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, sub-row, place and hash of every entry in the rows of a table."""
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, kind)]
    for docs, subs, counts, gaps, wide, hashes in zip(
        *(table.column(c).to_pylist() for c in ("docs", "subs", "counts", "gaps", "wide", "hashes")),
        strict=True,
    ):
        counts = np.frombuffer(counts, "<u4")
        gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
        gap[gap == 255] = np.frombuffer(wide, "<u4")
        sums = np.cumsum(gap)
        starts = np.cumsum(counts) - counts
        base = sums[starts] - gap[starts]
        out[0].append(np.repeat(np.frombuffer(docs, np.int64), counts))
        out[1].append(np.repeat(np.frombuffer(subs, "<u4").astype(np.int64), counts))
        out[2].append(sums - np.repeat(base, counts))
        out[3].append(np.frombuffer(hashes, kind))
    return tuple(np.concatenate(x) for x in out)


def _dealt(
    key: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray, hashes: np.ndarray
) -> Iterator[list]:
    """Packed rows by key; entries come in order of document and place."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[low:high]
        yield [int(key[low]), *_pack(doc[at], sub[at], place[at], hashes[at])]


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shard(doc: np.ndarray, shards: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _FIRST) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)


def _probes(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Every rolling run of ``block`` words, packed by bucket of its hash."""
    schema = _schema("bucket")
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in chunks(batch.column(1), BATCH_BYTES):
                words = Words(data, offsets)
                at, hashes = words.windows(words.hashes(), block)
                row = words.row[at]
                place = at - words.first[row]
                doc = ids[low:high][row]
                rows = list(
                    _dealt(_bucket(hashes, buckets), doc, np.zeros_like(doc), place, hashes.astype("<u4"))
                )
                yield from _table(rows, out).to_batches()

    given = docs.where("doc_id is not null").select("doc_id", "text")
    return given.mapInArrow(run, schema)


def _meet(probes: DataFrame, block: int, shards: int) -> DataFrame:
    """Hits of later documents on blocks of earlier ones, and these blocks, by shard of document."""
    schema = _schema("shard")
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        doc, sub, place, hashes = _unpack(table, np.dtype("<u4"))
        anchor = place % block == 0
        order = np.lexsort((doc[anchor], hashes[anchor]))
        known, owner = hashes[anchor][order], doc[anchor][order]
        if not len(known):
            return _table([], out)
        first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
        known, least = known[first], owner[first]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        met = known[at] == hashes
        hit = met & (least[at] < doc)
        latest = np.full(len(known), np.iinfo(np.int64).min)
        np.maximum.at(latest, at[met], doc[met])
        hit |= anchor & (latest[at] > doc)
        doc, sub, place, hashes = doc[hit], sub[hit], place[hit], hashes[hit]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        empty = np.zeros(len(doc), np.uint8)[:0]
        rows = []
        for row in _dealt(_shard(doc, shards), doc, np.zeros_like(doc), place, np.zeros(len(doc), np.uint8)):
            rows.append([*row[:-1], empty.tobytes()])
        return _table(rows, out)

    return probes.groupBy("bucket").applyInArrow(run, schema)


def _packed_texts(docs: DataFrame, shards: int) -> DataFrame:
    schema = "shard int, doc_id long, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            ids = batch.column(0)
            shard = _shard(ids.fill_null(0).to_numpy(zero_copy_only=False), shards)
            data, offsets = texts(batch.column(1))
            data, bounds = memoryview(data), offsets.tolist()
            packed = [press.compress(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), ids, pa.array(packed, pa.binary())],
                ["shard", "doc_id", "packed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _rows(table: pa.Table) -> tuple[list[int | None], list[bytes], np.ndarray, np.ndarray]:
    """Ids and texts of a shard in order, with ids as numbers and ranks among equal ids."""
    open_ = zstandard.ZstdDecompressor().decompress
    pairs = sorted(
        zip(table.column("doc_id").to_pylist(), map(open_, table.column("packed").to_pylist()), strict=True),
        key=lambda p: (p[0] is None, p[0] or 0, p[1]),
    )
    ids = [p[0] for p in pairs]
    known = np.array([i for i in ids if i is not None], np.int64)
    first = np.searchsorted(known, known)
    return ids, [p[1] for p in pairs], known, np.arange(len(known)) - first


def _windows(texts_by_shard: DataFrame, hits: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """The windows around hits, packed by bucket of their hash."""
    schema = _schema("bucket")
    out = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, raw, known, sub = _rows(left)
        hit_doc, _, hit_place, _ = _unpack(right, np.uint8)
        order = np.argsort(hit_doc, kind="stable")
        hit_doc, hit_place = hit_doc[order], hit_place[order]
        low, high = np.searchsorted(hit_doc, known), np.searchsorted(hit_doc, known, "right")
        wanted = np.flatnonzero(high > low)
        sizes = np.cumsum([len(raw[i]) for i in wanted])
        rows: list[list] = []
        for part in np.split(wanted, np.searchsorted(sizes, np.arange(BATCH_BYTES, sizes[-1], BATCH_BYTES)) if len(sizes) else []):
            if not len(part):
                continue
            lengths = [len(raw[i]) for i in part]
            data = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
            words = Words(data, np.concatenate([[0], np.cumsum(lengths)]))
            near = np.zeros(len(words) + 1, np.int32)
            for k, i in enumerate(part):
                n = words.first[k + 1] - words.first[k]
                at = hit_place[low[i] : high[i]]
                at = at[at < n]
                np.add.at(near, words.first[k] + np.maximum(at - (window - block), 0), 1)
                np.add.at(near, words.first[k] + at + 1, -1)
            near = np.cumsum(near) > 0
            at, hashes = words.windows(words.hashes(), window)
            at, hashes = at[near[at]], hashes[near[at]]
            row = words.row[at]
            rows += _dealt(
                _bucket(hashes, buckets), known[part][row], sub[part][row], at - words.first[row], hashes
            )
        return _table(rows, out)

    return texts_by_shard.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(run, schema)


def _repeats(windows: DataFrame, shards: int) -> DataFrame:
    """The windows that a document with a smaller id has too, by shard of document."""
    schema = _schema("shard")
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        doc, sub, place, hashes = _unpack(table, np.uint64)
        order = np.lexsort((doc, hashes))
        ordered = hashes[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        least = np.empty(len(doc), np.int64)
        least[order] = doc[order][first][np.cumsum(first) - 1] if len(ordered) else doc
        again = doc > least
        doc, sub, place = doc[again], sub[again], place[again]
        order = np.lexsort((place, sub, doc))
        doc, sub, place = doc[order], sub[order], place[order]
        none = np.zeros(len(doc), np.uint8)
        rows = [[*row[:-1], b""] for row in _dealt(_shard(doc, shards), doc, sub, place, none)]
        return _table(rows, out)

    return windows.groupBy("bucket").applyInArrow(run, schema)


def _cut(texts_by_shard: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    out = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw, known, sub = _rows(left)
        doc, of, place, _ = _unpack(right, np.uint8)
        order = np.lexsort((place, of, doc))
        doc, of, place = doc[order], of[order], place[order]
        low, high = np.searchsorted(doc, known), np.searchsorted(doc, known, "right")
        total, removed, kept = [], [], []
        for i, text in enumerate(raw):
            words = text.split()  # of bytes: on space and 0x09-0x0D
            n = len(words)
            if i < len(known) and high[i] > low[i]:
                at = place[low[i] : high[i]][of[low[i] : high[i]] == sub[i]]
                steps = np.zeros(n + 1, np.int32)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                words = list(compress(words, (np.cumsum(steps[:n]) == 0).tolist()))
            total.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        columns = (ids, total, removed, kept)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return texts_by_shard.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(run, schema)


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    buckets: int | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (words joined by one space).

    ``buckets``: groups that entries and documents are dealt into, by default
    one for each shuffle partition; a group must fit a task's memory. Packed rows
    are one for each pair of groups that share an entry, so never more than entries.
    """
    block = (window + 1) // 2
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    by_shard = _packed_texts(docs, buckets)
    hits = _meet(_probes(docs, block, buckets), block, buckets)
    windows = _windows(by_shard, hits, block, window, buckets)
    return _cut(by_shard, _repeats(windows, buckets), window)
