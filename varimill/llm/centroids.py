"""Centroid clustering in exact integers, with a table of pivot distances.

Vectors become integers on a grid. Their distances to fixed pivots, the first
centroids, are computed once and stored beside them. In each round the distances of
the centroids to the same pivots are known, and by the triangle inequality the largest
difference of two pivot distances bounds a vector's distance to a centroid from
below. The centroid with the least bound gets an exact distance; of the others only
those whose bound does not exceed the best distance so far, until none is left.
Bounds carry a margin for rounding, so ties and all results are exact.

The vectors stay where they are: a round reads the stored table, and each task hands
on one row of sums per centroid. Only centroids pass through the driver, whose number
and size are parameters.

A vector that is null, of another length, or holds a null or a number that is not
finite is left out. A null id is hashed as an empty one. Repeated rows are vectors of
their own; of vectors with the same id the smaller in component order is the first.
With fewer vectors than centroids there are as many centroids as vectors. A component
so large that a distance might not fit a long (beyond 2^27 on the grid, for 64
components) ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import arrow_schema, stored

DIMENSIONS = 64
GRID = 64
CENTROIDS = 16
ROUNDS = 3
_MARGIN = 1e-9  # relative, for rounding in square roots and differences
_STEP = 8192  # vectors worked on at once


def on_grid(vectors: DataFrame, vector: str, dimensions: int = DIMENSIONS, grid: int = GRID) -> DataFrame:
    """Vectors of the right length with finite components only, as ``floor(grid * x)``
    in the column ``vector``; the product is taken in double."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.where((F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    # As doubles: one that is too large for a long is refused, not wrapped.
    scaled = F.transform(x, lambda v: F.lit(float(grid)) * v)
    largest = isqrt((1 << 62) // dimensions) // 2
    large = F.exists(scaled, lambda v: F.abs(v) > largest)
    refused = F.raise_error(F.lit(f"a component lies beyond {largest} on the grid")).cast("array<int>")
    return rows.withColumn(vector, F.when(large, refused).otherwise(F.transform(scaled, lambda v: F.floor(v).cast("int"))))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, dimensions)


def _squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own point."""
    apart = rows - points
    return np.einsum("ij,ij->i", apart, apart)


def _pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, rounded, of all rows to all pivots."""
    return np.sqrt(np.stack([_squares(rows, p) for p in pivots], 1).astype(np.float64))


def nearest(
    rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest centroid (of equals the first), the squared distance,
    and over all rows the number of exact distances that were computed.
    """
    n, k = len(rows), len(centroids)
    of_centroids = _pivot_distances(centroids, pivots)
    below = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(below, np.abs(to_pivots[:, p, None] - of_centroids[None, :, p]), out=below)
    # A bound of a rounded difference may be too high by the rounding of its parts.
    slack = _MARGIN * (1.0 + to_pivots.max(1) + of_centroids.max())
    below = np.maximum(below - slack[:, None], 0.0)
    order = np.argsort(below, 1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    chosen = np.zeros(n, np.int64)
    left = np.arange(n)
    exact = 0
    for turn in range(k):
        at = order[left, turn]
        # Bounds only rise along the order: what exceeds the best now is done.
        reach = np.sqrt(best[left].astype(np.float64)) * (1 + _MARGIN)
        open_ = below[left, at] <= reach
        left, at = left[open_], at[open_]
        if not len(left):
            break
        found = _squares(rows[left], centroids[at])
        exact += len(left)
        better = (found < best[left]) | ((found == best[left]) & (at < chosen[left]))
        best[left[better]], chosen[left[better]] = found[better], at[better]
    return chosen, best, exact


def _first(grid: DataFrame, vec_id: str, vector: str, n: int, seed: str) -> np.ndarray:
    """The vectors with the least hashes of their ids."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    rows = grid.select(key.alias("key"), F.col(vector).alias("v")).orderBy("key", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _assigned(
    table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, fields: list[T.StructField], emit
) -> DataFrame:
    """``emit(ids, rows, cluster, squares)`` for the vectors of every batch, as Arrow
    batches; a batch of None is asked for at the end of a task."""
    schema = T.StructType(fields)
    out = arrow_schema(schema)
    sent = table.sparkSession.sparkContext.broadcast((centroids, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pivots = sent.value
        give = emit()
        for batch in batches:
            for low in range(0, batch.num_rows, _STEP):
                part = batch.slice(low, _STEP)
                rows = _matrix(part.column(1), centroids.shape[1])
                to_pivots = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                chosen, squares, exact = nearest(rows, to_pivots, centroids, pivots)
                made = give(part.column(0), rows, chosen, squares, exact)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, out, strict=True)], schema=out)
        made = give(None, None, None, None, 0)
        if made is not None:
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, out, strict=True)], schema=out)

    return table.mapInArrow(run, schema)


class _Sums:
    """Adds up the vectors of each cluster in a task, for one row per cluster."""

    def __init__(self) -> None:
        self.sums: np.ndarray | None = None
        self.counts: np.ndarray | None = None
        self.exact = 0
        self.k = 0

    def __call__(self, ids, rows, chosen, squares, exact):
        if rows is None:
            if self.sums is None:
                return None
            filled = np.flatnonzero(self.counts)
            exact = np.zeros(len(filled), np.int64)
            exact[0] = self.exact
            return [
                pa.array(filled),
                pa.array(self.counts[filled]),
                pa.array(self.sums[filled].tolist(), pa.list_(pa.int64())),
                pa.array(exact),
            ]
        width = int(chosen.max()) + 1
        if self.sums is None or width > len(self.sums):
            sums, counts = np.zeros((width, rows.shape[1]), np.int64), np.zeros(width, np.int64)
            if self.sums is not None:
                sums[: len(self.sums)], counts[: len(self.counts)] = self.sums, self.counts
            self.sums, self.counts = sums, counts
        self.counts[:width] += np.bincount(chosen)
        for c in np.unique(chosen):
            self.sums[c] += rows[chosen == c].sum(0)
        self.exact += exact
        return None


_SUMS = [
    T.StructField("cluster", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("sums", T.ArrayType(T.LongType())),
    T.StructField("exact", T.LongType()),
]


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many exact distances it took."""
    rows = _assigned(table, centroids, pivots, _SUMS, _Sums)
    wide = "decimal(38,0)"
    parts = rows.select("cluster", "n", "exact", F.posexplode("sums").alias("place", "x"))
    totals = parts.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast(wide)).alias("x"), F.sum("exact").alias("exact")
    )
    moved, exact = centroids.copy(), 0
    # As many rows as centroids have components.
    for r in totals.collect():
        moved[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
        exact += r["exact"] if r["place"] == 0 else 0
    return moved, exact


def _digest(centroid: np.ndarray) -> str:
    return sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    grid: int = GRID,
    n_centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: str = "1:",
    report: list[int] | None = None,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``,
    ``centroid`` (its final components) and ``centroid_sha256`` for every vector kept.

    ``report`` takes the number of exact distances of each round.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    kept = on_grid(kept, "v", dimensions, grid)
    id_type = kept.schema["vec_id"].dataType
    pivots = centroids = _first(kept, "vec_id", "v", n_centroids, seed)
    fields = [
        T.StructField("vec_id", id_type),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()),
    ]
    if not len(centroids):
        none = T.StructType([*fields, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())), T.StructField("centroid_sha256", T.StringType())])
        return spark.createDataFrame([], none)
    table = stored(_with_pivots(kept, pivots, id_type), "pivots")
    for _ in range(rounds):
        centroids, exact = _moved(table, centroids, pivots)
        if report is not None:
            report.append(exact)

    def emit():
        def give(ids, rows, chosen, squares, exact):
            return None if rows is None else [ids, pa.array(chosen), pa.array(squares)]

        return give

    found = stored(_assigned(table, centroids, pivots, fields, emit), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # At most a row per centroid.
    inertias = {r["cluster"]: int(r["s"]) for r in sums.collect()}
    total = sum(inertias.values())
    told = [(c, s, total, centroids[c].tolist(), _digest(centroids[c])) for c, s in sorted(inertias.items())]
    names = "c_cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    joined = found.join(F.broadcast(spark.createDataFrame(told, names)), F.col("cluster") == F.col("c_cluster"))
    return joined.drop("c_cluster")


def _with_pivots(kept: DataFrame, pivots: np.ndarray, id_type: T.DataType) -> DataFrame:
    """Vectors on the grid with their distances to the pivots."""
    schema = T.StructType(
        [
            T.StructField("vec_id", id_type),
            T.StructField("v", T.ArrayType(T.IntegerType())),
            T.StructField("to_pivots", T.ArrayType(T.DoubleType())),
        ]
    )
    out = arrow_schema(schema)
    sent = kept.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _STEP):
                part = batch.slice(low, _STEP)
                to_pivots = _pivot_distances(_matrix(part.column(1), sent.value.shape[1]), sent.value)
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * to_pivots.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(to_pivots.ravel()))
                arrays = [a.cast(f.type) for a, f in zip([part.column(0), part.column(1), lists], out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return kept.select("vec_id", "v").mapInArrow(run, schema)
