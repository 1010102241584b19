"""Centroid clustering of integer vectors with Hamerly's bounds: every assignment exact, few distances computed.

Each vector carries its cluster, an upper bound of the distance to its centroid and one lower bound of the distance to
the second nearest. When the centroids move, the upper bound grows by the drift of its own centroid and the lower one
shrinks by the largest drift of the others. A vector keeps its cluster without any distance while its upper bound is
under its lower bound or under half the distance from its centroid to the nearest other centroid; else the upper bound
is measured again, and if that isn't enough either, all centroids are scanned in exact integers (ties to the smaller
number). Bounds are doubles and tests are strict by more than their rounding, so no tie is decided by a bound.

Each round writes the vectors with their bounds as Parquet to the shared folder and then removes the round's before it,
so an executor that is lost costs one round's tasks. Sums of clusters are kept as exact integers and change only by the
vectors that changed cluster. The driver holds the centroids (k times DIMENSIONS integers) and nothing that grows.

A component x becomes the integer floor(1024 * x); vectors of another length than `dimensions`, null ones and those with
null or non-finite components take no part. Components beyond LARGEST count as LARGEST, as distances are to fit a long.
Centroids start as the k vectors of smallest sha256 of `<seed>:<id>`, equal ones in order of their components; fewer
vectors make fewer centroids. Repeated rows are vectors of their own; rows of null id come last as starts; an empty table
gives no rows; other columns are left out; ids may be of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discarded, stored

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024
LARGEST = 1 << 27
#: How far apart bounds must be beyond their rounding, relative and absolute.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, *, id: str, vector: str, dimensions: int) -> DataFrame:
    """_id, v: the vectors that take part, as integers."""
    whole = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * SCALE))))).cast("int"))
    return rows.filter(F.col(vector).isNotNull() & whole).select(F.col(id).alias("_id"), scaled.alias("v"))


def matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors from one centre, or from one each."""
    gap = vectors - centre
    return np.einsum("ij,ij->i", gap, gap)


def scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: the nearest centroid, its squared distance and that of the second nearest (infinite if there is none)."""
    found = np.stack([squared(vectors, c) for c in centroids], axis=1)
    nearest = found.argmin(axis=1)
    first = found[np.arange(len(vectors)), nearest]
    others = found.astype(np.float64)
    others[np.arange(len(vectors)), nearest] = np.inf
    return nearest, first, others.min(axis=1)


class Move:
    """How the centroids lie and by how much they moved since the bounds were written."""

    def __init__(self, centroids: np.ndarray, former: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        self.drift = np.zeros(k) if former is None else np.sqrt(squared(centroids, former).astype(np.float64)) * (1 + SLACK)
        self.other_drift = np.array([np.delete(self.drift, j).max(initial=0) for j in range(k)])
        gaps = np.array([[np.inf if i == j else float(squared(centroids[i : i + 1], centroids[j])[0]) for j in range(k)] for i in range(k)])
        self.half = np.sqrt(gaps.min(axis=1, initial=np.inf)) / 2 * (1 - SLACK)

    def reassigned(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower after the move, and which vectors had all centroids scanned. cluster -1: not assigned yet."""
        new = cluster < 0
        cluster = cluster.copy()
        upper = np.where(new, np.inf, upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.where(new, 0.0, np.maximum(0.0, lower - self.other_drift[cluster])) * (1 - SLACK)
        limit = np.maximum(lower, np.where(new, 0.0, self.half[cluster]))
        unsure = np.flatnonzero(~(upper + SLACK < limit))
        again = unsure[~new[unsure]]
        upper[again] = np.sqrt(squared(vectors[again], self.centroids[cluster[again]]).astype(np.float64)) * (1 + SLACK)
        unsure = unsure[~(upper[unsure] + SLACK < limit[unsure])]
        nearest, first, second = scanned(vectors[unsure], self.centroids)
        cluster[unsure], upper[unsure], lower[unsure] = nearest, np.sqrt(first.astype(np.float64)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        scans = np.zeros(len(vectors), bool)
        scans[unsure] = True
        return cluster, upper, lower, scans


def assigned(state: DataFrame, move: Move, dimensions: int) -> DataFrame:
    """The state after a move: cluster and bounds anew, the cluster before as `former`, whether a vector was scanned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                former, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, scans = move.reassigned(matrix(batch.column("v"), dimensions), former, upper, lower)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(former, pa.int32()), pa.array(scans)], ["_id", "v", "cluster", "upper", "lower", "former", "scanned"])

    return state.select("_id", "v", "cluster", "upper", "lower").mapInArrow(work, f"_id {state.schema['_id'].dataType.simpleString()}, v array<int>, cluster int, upper double, lower double, former int, scanned boolean")


def changes(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and sizes of the clusters changed: a row a cluster and component from each task, added up by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                ones = np.ones((batch.num_rows, 1), np.int64)
                rows = np.concatenate([matrix(batch.column("v"), dimensions), ones], axis=1)
                to, off = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "former"))
                np.add.at(total, to, rows)
                np.subtract.at(total, off[off >= 0], rows[off >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["cell", "x"])

    moved = state.filter("cluster <> former").select("v", "cluster", "former").mapInArrow(work, "cell int, x long")
    out = np.zeros(k * (dimensions + 1), object)
    for r in moved.groupBy("cell").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (dimensions + 1) rows
        out[r["cell"]] = int(r["x"])
    out = out.reshape(k, dimensions + 1)
    return out[:, :-1], out[:, -1]


def clustered(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int | str = SEED, log: list[int] | None = None) -> DataFrame:
    """id, cluster, distance (squared), centroid_sha256 of each vector. log: gets the number of vectors scanned in each assignment."""
    vectors = integer_vectors(bounded_batches(rows), id=id, vector=vector, dimensions=dimensions)
    state = stored(vectors.select("_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = state.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids, former = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions), None
    sums, sizes = np.zeros(centroids.shape, object), np.zeros(len(first), object)
    for i in range(rounds + 1 if len(first) else 0):
        after = stored(assigned(state, Move(centroids, former), dimensions), "vectors")
        discarded(state)
        state = after
        if log is not None:
            log.append(state.filter("scanned").count())
        if i < rounds:
            more = changes(state, len(first), dimensions)
            sums, sizes = sums + more[0], sizes + more[1]
            former = centroids
            centroids = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, sizes, centroids, strict=True)], np.int64)
            if np.array_equal(centroids, former):  # so nothing will change in the rounds that are left
                break
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            far = squared(matrix(batch.column("v"), dimensions), centroids[cluster]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cluster, pa.int32()), pa.array(far, pa.int64()), pa.array([names[c] for c in cluster], pa.string())], ["_id", "cluster", "distance", "centroid_sha256"])

    return state.select("_id", "v", "cluster").mapInArrow(measured, f"_id {state.schema['_id'].dataType.simpleString()}, cluster int, distance long, centroid_sha256 string").withColumnRenamed("_id", id)


def with_inertia(found: DataFrame) -> DataFrame:
    """Adds cluster_inertia and inertia: distances added up over the cluster and over all."""
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = by.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(by.crossJoin(F.broadcast(whole))), "cluster")  # a row a cluster
