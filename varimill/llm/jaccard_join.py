"""Exact n-gram Jaccard join by parity sketches.

A document's set of word shingles is folded into a sketch of 2^b parts by the
leading bits of each shingle's hash; a part is the XOR of the hashes in it. Each
shingle in which two sets differ changes at most one part, so the number of
differing parts bounds the symmetric difference from below. Two sets of sizes m
and n with similarity s differ in at most D = (m + n)(1 - s)/(1 + s) shingles:
of N parts that are not empty, N - D agree. By the pigeonhole principle they then
share one of the D + 1 parts that come first in any fixed order. These are the
join keys, per size band (b: bits of the larger set's size). Parts known to be
frequent come last in the order, which keeps common passages out of the keys.

The same parity idea on single bits gives each document a bit sketch of about
one bit per shingle. Of the documents that share a key only those stay together
whose bit sketches differ in at most D places; they form candidate clusters.
Inside a cluster, or between two blocks of a large one, the sets themselves are
compared. Both steps follow links from each document found to the ones not
reached yet, so no group is expanded to all its pairs. Equal sets are one node
from the start.

Null and empty texts have no shingles and no links. A null id has no component.
Rows with the same id are taken as rows of their own with that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import arrow_schema, give_back, key_filter, maybe_in, stored, unused
from varimill.llm.graph import components
from varimill.llm.words import Words, chunks, mix

WIDTH = 5
SIMILARITY = 80  # percent
HINT_BITS = 20
HINT_SHARE = 8  # one document in so many is looked at to see which parts are frequent
BLOCK_MEMBERS = 4096  # documents under one key that a task compares with themselves or another block
BLOCK_SHINGLES = 1_000_000  # of a cluster that one task compares with itself or another block
_SALTS = 8
_NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _digest(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total])).view(np.int64)[0])


def _parts(shingles: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """The parts of a sketch that are not empty, as keys that name band and place."""
    if salt:
        shingles = np.sort(mix(shingles + np.uint64(salt)))
    place = shingles >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    folded = np.bitwise_xor.reduceat(mix(shingles), starts)
    keys = mix(folded + place[starts] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(bits << 8 | salt))
    return keys & ~np.uint64(63) | np.uint64(bits)  # the low bits say which band


def bit_sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """2^bits parities, at least 64, as words; the next smaller sketch is the XOR
    of its halves."""
    bits = max(bits, 6)
    place = (mix(shingles) & np.uint64((1 << bits) - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=1 << bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def _bands(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """(bits, largest difference) of the bands a set of this size takes part in."""
    largest = n * 100 // percent
    for bits in range(n.bit_length(), largest.bit_length() + 1):
        other = min(largest, (1 << bits) - 1)
        yield bits, (n + other) * (100 - percent) // (100 + percent)


def sketch_keys(shingles: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """The join keys of a set: two sets of at least this similarity share one."""
    found = [np.zeros(0, np.uint64)]
    for bits, differ in _bands(len(shingles), percent):
        if not differ:
            continue  # only equal sets are that similar
        for salt in range(_SALTS):
            parts = _parts(shingles, bits, salt)
            if len(parts) <= differ:
                # Too many shingles fell together for the principle to hold between
                # two such sets: they meet under another folding as well.
                found.append(parts)
                continue
            order = parts >> np.uint64(8)
            if common is not None:
                order |= common[parts & np.uint64(len(common) - 1)].astype(np.uint64) << np.uint64(56)
            found.append(parts[np.argpartition(order, differ)[: differ + 1]])
            break
        else:
            found.append(mix(np.array([bits], np.uint64)) & ~np.uint64(63) | np.uint64(bits))
    return np.concatenate(found)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets, lower=True)
        yield from words.shingles(words.hashes(), width)


def _frequent_parts(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """How often parts occur, by hash bucket: 2^20 small numbers whatever the input.

    Only puts the keys in an order, which may be any; one document in
    ``HINT_SHARE`` is enough to find what is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000))
        for batch in slices:
            parts = [np.zeros(0, np.uint64)]
            for shingles in _sets(batch.column(0), width):
                for bits, differ in _bands(len(shingles), percent):
                    if differ:
                        parts.append(_parts(shingles, bits, 0))
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            keys, counts = keys[counts > 1], counts[counts > 1]
            bucket = (keys & np.uint64((1 << HINT_BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts)], ["bucket", "n"])
        give_back()

    looked = docs.where(F.pmod(F.xxhash64("row_key"), F.lit(HINT_SHARE)) == 0)
    counted = looked.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket")
    rows = counted.agg(F.least(F.sum("n"), F.lit(255)).alias("n")).toPandas()
    table = np.zeros(1 << HINT_BITS, np.uint8)
    table[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.uint8)
    return table


def _nodes(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """A row per document: set size, node, and for the first document with its set
    in an Arrow batch the join keys and the bit sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = arrow_schema(_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            node, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys, counts, sketches, seen = [np.zeros(0, np.uint64)], np.zeros(n + 1, np.int32), [None] * n, set()
            for i, shingles in enumerate(_sets(batch.column(2), width)):
                size[i] = len(shingles)
                if not len(shingles):
                    continue
                node[i] = _digest(shingles)
                if node[i] not in seen:
                    seen.add(node[i])
                    keys.append(sketch_keys(shingles, percent, shared.value))
                    counts[i + 1] = len(keys[-1])
                    largest = max(bits for bits, _ in _bands(len(shingles), percent))
                    sketches[i] = bit_sketch(shingles, largest).tobytes()
            offsets = pa.array(np.cumsum(counts, dtype=np.int32))
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(size),
                batch.column(3),
                pa.array(node),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64))),
                pa.array(sketches, pa.binary()),
            ]
            arrays = [a.cast(f.type) for a, f in zip(arrays, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            del batch, arrays, keys, sketches, seen
            give_back()

    return docs.select("doc_id", "row_key", "text", "text_key").mapInArrow(run, _NODES)


def _near(sizes: np.ndarray, sketches: list[bytes], bits: int, percent: int) -> list[tuple[int, int]]:
    """Pairs that span the graph of bit sketches which may be similar enough."""
    words = 1 << max(bits, 6) - 6
    folded = []
    for raw in sketches:
        sketch = np.frombuffer(raw, np.uint64)
        while len(sketch) > words:
            sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
        folded.append(sketch)
    table = np.stack(folded)
    left = np.argsort(sizes, kind="stable")
    pairs, queue = [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        at = queue.pop()
        low = np.searchsorted(sizes[left], -(-sizes[at] * percent // 100), "left")
        high = np.searchsorted(sizes[left], sizes[at] * 100 // percent, "right")
        near = left[low:high]
        apart = np.bitwise_count(table[near] ^ table[at]).sum(1)
        met = apart <= (sizes[near] + sizes[at]) * (100 - percent) // (100 + percent)
        pairs += [(at, i) for i in near[met]]
        queue += near[met].tolist()
        keep = np.ones(len(left), bool)
        keep[low:high] = ~met
        left = left[keep]
    return pairs


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a key and have near bit sketches, enough of them
    to connect all that do."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    beside = Window.partitionBy("key").orderBy("node")
    met = keyed.withColumns({"o1": F.lag("node").over(beside), "o2": F.lead("node").over(beside)})
    met = stored(met.where("o1 <> node or o2 <> node").select("key", "node").distinct(), "shared")
    groups = met.groupBy("key").agg(
        F.count("*").alias("n_members"), F.sum(F.col("node").cast("decimal(38,0)")).alias("s"), F.bit_xor("node").alias("x")
    )
    # Keys with the same members say the same; one of them is enough.
    band = F.col("key").bitwiseAND(63)
    chosen = groups.groupBy(band.alias("band"), "n_members", "s", "x").agg(F.min("key").alias("key"))
    chosen = chosen.select("key", "band", F.ceil(F.col("n_members") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    sketches = nodes.where("sketch is not null").groupBy("node").agg(
        F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = met.join(chosen, "key").withColumns(
        {"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
    )
    packs = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(packs)))
    rows = rows.join(sketches, "node").select(
        pack.alias("pack"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "key",
        "band",
        "node",
        "n_shingles",
        "sketch",
    )

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
        node, size, band = (table.column(c).to_numpy()[order] for c in ("node", "n_shingles", "band"))
        sketch = [raw.as_py() for raw in table.column("sketch").take(pa.array(order))]
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            for x, y in _near(size[low:high], sketch[low:high], int(band[low]), percent):
                a.append(node[low + x])
                b.append(node[low + y])
        del sketch
        give_back()
        return pa.table({"a": a, "b": b}, schema=arrow_schema(_LINKS))

    return rows.groupBy("pack", "i", "j").applyInArrow(run, _LINKS)


def _reached(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the similarity graph of the sets, by walking from set to set."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    ids_of = np.split(ids, ends[:-1])
    marked = np.zeros(ids.max() + 1 if len(ids) else 0, bool)
    left = np.argsort(sizes, kind="stable")  # not reached yet, by size
    links, queue = [], []
    flat = starts = None
    while len(left):
        if not queue:
            queue, left, flat = [left[0]], left[1:], None
            continue
        if flat is None:
            flat = np.concatenate([ids_of[i] for i in left])
            starts = np.concatenate([[0], np.cumsum(sizes[left])])
        at = queue.pop()
        low = np.searchsorted(sizes[left], -(-sizes[at] * percent // 100), "left")
        high = np.searchsorted(sizes[left], sizes[at] * 100 // percent, "right")
        if low == high:
            continue
        marked[ids_of[at]] = True
        hits = np.add.reduceat(marked[flat[starts[low] : starts[high]]].astype(np.int64), starts[low:high] - starts[low])
        marked[ids_of[at]] = False
        near = left[low:high]
        linked = 100 * hits >= percent * (sizes[at] + sizes[near] - hits)
        if linked.any():
            found = near[linked].tolist()
            links += [(at, i) for i in found]
            queue += found
            keep = np.ones(len(left), bool)
            keep[low:high] = ~linked
            left, flat = left[keep], None
    return links


def _links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Compare the sets of every cluster. Large clusters are dealt out as pairs of
    blocks; small ones share a task."""
    members = nodes.where("n_shingles > 0").groupBy("node").agg(
        F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n")
    )
    members = stored(members.join(clusters, "node"), "members")
    totals = members.groupBy("component").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    totals = totals.select("component", blocks.alias("blocks"))
    whole = members.agg(F.sum("n")).first()[0] or 0
    packs = max(1, whole // BLOCK_SHINGLES * 4)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(totals, "component").select(
        "node",
        "row_key",
        "component",
        F.when(F.col("blocks") > 1, F.col("component"))
        .otherwise(F.pmod(F.xxhash64("component"), F.lit(packs)))
        .alias("pack"),
        own.alias("own"),
        other.alias("other"),
    )
    dealt = dealt.select(
        "node",
        "row_key",
        "component",
        "pack",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
    )
    texts = maybe_in(docs.select("row_key", "text"), "row_key", key_filter(members, "row_key"))
    rows = texts.join(dealt, "row_key").select("pack", "i", "j", "component", "node", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("text")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        by_cluster: dict[int, dict[int, np.ndarray]] = {}
        names = zip(table.column("component").to_pylist(), table.column("node").to_pylist(), strict=True)
        for (cluster, node), shingles in zip(names, _sets(column, width), strict=True):
            # Another row may have the same id but another text.
            if len(shingles) and _digest(shingles) == node:
                by_cluster.setdefault(cluster, {})[node] = shingles
        links = [
            (list(found)[a], list(found)[b])
            for found in by_cluster.values()
            for a, b in _reached(list(found.values()), percent)
        ]
        by_cluster.clear()
        give_back()
        return pa.table({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema=arrow_schema(_LINKS))

    return rows.groupBy("pack", "i", "j").applyInArrow(run, _LINKS)


def join_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = SIMILARITY,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``text_key`` (the xxhash64 of the
    text, which tells rows with the same id apart) and ``class_key`` for every row of
    ``docs``.

    The component id is the least document id that links reach. Where ids repeat, two
    classes may have the same; their class keys differ. A text without words has none.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        key.alias("row_key"),
        F.col(text).alias("text"),
        F.xxhash64(text).alias("text_key"),
    )
    common = _frequent_parts(docs, width, percent)
    nodes = stored(_nodes(docs, width, percent, common), "sketches")
    clusters = components(_candidates(nodes, percent))
    classes = components(_links(docs, nodes, clusters, width, percent))
    rows = nodes.select("doc_id", "n_shingles", "text_key", "node").join(classes, "node", "left")
    rows = rows.withColumn("class", F.coalesce("component", "node"))
    # Equal sets are one class without a link; texts without shingles are none.
    filled = rows.where("n_shingles > 0")
    least = filled.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = ("doc_id", "n_shingles", "component_id", "text_key")
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    empty = empty.select(*out, F.lit(None).cast("long").alias("class_key"))
    return filled.join(least, "class").select(*out, F.col("class").alias("class_key")).unionByName(empty)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that with the least id.

    Texts without words and rows without id all stay. Of rows with the same id, each
    class keeps one of its own.
    """
    classes = join_classes(docs, doc_id, text, **options).where("n_shingles > 0 and doc_id is not null")
    first = classes.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    names = [unused("_id", docs.columns), unused("_text", docs.columns)]
    first = first.select(F.col("k.doc_id").alias(names[0]), F.col("k.text_key").alias(names[1]))
    # Rows of equal id and text are the same to the join; one is enough.
    keys = dict(zip(names, (F.col(doc_id).cast("long"), F.xxhash64(text)), strict=True))
    chosen = docs.withColumns(keys).join(first, names, "left_semi")
    chosen = chosen.dropDuplicates(names).select(*docs.columns)
    bare = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    return chosen.unionByName(docs.where(F.col(doc_id).isNull() | bare))
