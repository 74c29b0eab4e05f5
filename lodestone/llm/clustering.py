"""Centroid clustering with block-norm screening.

Vectors of integers are cut into segments. Of each segment two numbers are kept, once: its sum s, and what is left of
its squared norm beside the sum, r = len * |segment|^2 - s^2. With the same two numbers of a centroid, Cauchy-Schwarz
bounds the product of two segments by (s s' + sqrt(r r')) / len, so that these compressed vectors give a lower bound of
the squared distance: |x|^2 + |c|^2 - 2 * (sum of the bounds). A vector first meets the centroid of the least bound;
only centroids whose bound does not exceed the best distance so far get an exact integer distance.

A round is one pass: tasks assign their vectors and hand on a sum and a count for each centroid, which are added up by
centroid and component. The driver holds the k centroids only.

Defined results
- Only vectors of exactly ``dim`` components take part, none null or non-finite, with an id that is not null. Components are below 2^27 in size;
  beyond it is an error, as distances would not fit 64 bits, and so is an inertia beyond 64 bits.
- Centroids start as the k vectors with the least sha256 of ``seed:id`` (ties, which only repeated ids give: by components). With fewer vectors
  there are fewer centroids; an empty table gives an empty result.
- Ties of distances go to the smaller number. Empty centroids stay as they are. Rows that repeat an id count as rows of their own.
- Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved
from lodestone.llm.vectors import integer_vectors

SEGMENT = 4
LARGEST = 1 << 27


def compressed(x: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Sum and rest of each segment of each row; the last segment may be shorter."""
    starts = np.arange(0, x.shape[1], segment)
    width = np.diff(np.append(starts, x.shape[1]))
    s = np.add.reduceat(x, starts, axis=1)
    return s, width * np.add.reduceat(x * x, starts, axis=1) - s * s


def lower_bounds(norms: np.ndarray, sums: np.ndarray, rest: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """For each row and centroid a number that its squared distance does not fall below (rounding is allowed for)."""
    s, r = compressed(centroids, segment)
    width = np.minimum(segment, centroids.shape[1] - np.arange(0, centroids.shape[1], segment))
    most = (sums / width) @ s.T.astype(float) + np.sqrt(rest / width) @ np.sqrt(r / width).T
    both = norms[:, None].astype(float) + (centroids * centroids).sum(axis=1)
    return both - 2 * most - 1e-9 * both - 1


def nearest(x: np.ndarray, sums: np.ndarray, rest: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, and how many exact distances that took."""
    low = lower_bounds((x * x).sum(axis=1), sums, rest, centroids, segment)
    cluster = low.argmin(axis=1)
    first = cluster.copy()
    distance = ((x - centroids[first]) ** 2).sum(axis=1)
    exact = len(x)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero((low[:, j] <= distance) & (first != j))
        d = ((x[rows] - c) ** 2).sum(axis=1)
        better = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = j, d[better]
        exact += len(rows)
    return cluster, distance, exact


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.reshape(-1), kind))


def prepared(df: DataFrame, id_col: str, vec_col: str, scale: float, dim: int, segment: int = SEGMENT) -> DataFrame:
    """id, v, sums, rest: written once, so that rounds read integers and segment norms."""
    rows = integer_vectors(df.filter(F.size(vec_col) == dim), id_col, vec_col, scale, LARGEST).select("id", F.col("v").cast("array<int>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, r = compressed(_matrix(batch.column(1), batch.num_rows), segment)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(s, pa.int64()), _lists(r, pa.int64())], names=["id", "v", "sums", "rest"])

    return saved(rows.mapInArrow(run, "id long, v array<int>, sums array<long>, rest array<long>"), "vectors")


def assigned(rows: DataFrame, centroids: list[list[int]], segment: int = SEGMENT) -> DataFrame:
    """id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(*[_matrix(batch.column(i), batch.num_rows) for i in (1, 2, 3)], c, segment)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def moved(rows: DataFrame, centroids: list[list[int]], segment: int = SEGMENT) -> list[list[int]]:
    """The centroids after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, dtype=np.int64)
        total, n = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                cluster, _, _ = nearest(x, _matrix(batch.column(2), len(x)), _matrix(batch.column(3), len(x)), c, segment)
                np.add.at(total, cluster, x)
                n += np.bincount(cluster, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), _lists(total[used], pa.int64())], names=["cluster", "n", "total"])

    parts = rows.mapInArrow(run, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(30,0)")).alias("x"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k times dim numbers
        out[r.cluster][r.at] = int(r.x) // r.n
    return out


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, scale: float = 64.0, dim: int = 64, seed: str = "1", segment: int = SEGMENT) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid (the final one of its cluster)."""
    spark = df.sparkSession
    rows = prepared(df, id_col, vec_col, scale, dim, segment)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(rows, centroids, segment)
    found = saved(assigned(rows, centroids, segment), "clusters")
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k numbers
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia goes beyond 64 bits")
    facts = [(j, inertia.get(j, 0), sum(inertia.values()), c) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
