"""Centroid clustering of integer vectors with a LAESA pivot table.

Vectors become integers, so distances, means and ties are exact and reruns agree. The distances of
every vector to a few fixed pivots are computed once and stored beside it. In each round the
centroids' distances to the same pivots are known too, and by the triangle inequality the largest
difference of the two rows bounds the distance of vector and centroid from below. The centroid
with the least bound is measured first; only centroids whose bound doesn't exceed that distance
are measured as well. A round is one pass over the table, which gives a row of sums a task and
centroid; what reaches the driver is k centroids.

Defined results: vectors that are null, of another dimension, or with null, infinite or not-a-number
components are left out, as are those with a component of LARGEST or more in size, whose squared
distances don't fit 64 bits; rows that repeat count each; a row without id is clustered, and is a
first centroid only if rows with ids don't suffice; of equal distances the smaller centroid number
wins; a centroid without vectors stays; with fewer vectors than k there are as many centroids as
vectors; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize

#: Components below it, times 1024, have squared distances that fit 64 bits in 64 dimensions.
LARGEST = 1 << 17


@dataclass(frozen=True)
class Clustering:
    """k centroids after `rounds` rounds over vectors of `dimension` components, each times `scale`
    and floored. pivots are chosen from the `sample` vectors with the least hashes."""

    k: int = 8
    rounds: int = 10
    dimension: int = 64
    scale: int = 1024
    seed: int = 3
    pivots: int = 16
    sample: int = 256


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a point, in integers."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def roots(squared: np.ndarray) -> np.ndarray:
    """Floors of square roots, exact."""
    root = np.sqrt(squared.astype(np.float64)).astype(np.int64)
    root -= root * root > squared
    return root + ((root + 1) * (root + 1) <= squared)


def pivot_rows(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to each pivot, floored: a row a vector."""
    return np.stack([roots(squares(rows, p)) for p in pivots], axis=1) if len(rows) else np.zeros((0, len(pivots)), np.int64)


def choose_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows that lie far apart: each is the farthest from those before it."""
    chosen, near = [0], squares(rows, rows[0])
    while len(chosen) < min(n, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(rows, rows[chosen[-1]]))
    return rows[chosen]


def nearest(
    rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, centroid_table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many pairs were measured.
    Floored distances differ from true ones by less than 1, which comes off the bound."""
    bound = np.stack([np.abs(table - c).max(axis=1) for c in centroid_table], axis=1) - 1
    bound = np.maximum(bound, 0) ** 2
    first = bound.argmin(axis=1)
    apart = rows - centroids[first]
    known = np.einsum("ij,ij->i", apart, apart)
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[np.arange(len(rows)), first] = known
    measured = len(rows)
    for c, point in enumerate(centroids):
        left = np.flatnonzero((bound[:, c] <= known) & (first != c))
        found[left, c] = squares(rows[left], point)
        measured += len(left)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(rows)), best], measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _kept(how: Clustering) -> Column:
    """Whether `embedding` is a vector to cluster; never null."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return F.coalesce((F.size("embedding") == how.dimension) & fine, F.lit(False))


def integers(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """vec_id and v, the integer vector, of the rows to cluster."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(how.scale)).cast("int"))
    return vectors.where(_kept(how)).select("vec_id", v.alias("v"))


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with p, each vector's floored distances to the pivots, stored."""
    kind, width = rows.schema["vec_id"].dataType.simpleString(), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pivot_rows(_matrix(batch.column(1), width), pivots).astype(np.int32)
            at = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(p.ravel()))],
                names=["vec_id", "v", "p"]
            )

    return materialize(rows.mapInArrow(run, f"vec_id {kind}, v array<int>, p array<int>"), "laesa")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """cluster, at and total of each cluster's components, and of its size at -1."""
    near, width = pivot_rows(centroids, pivots), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width + 1), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            best, _, _ = nearest(rows, _matrix(batch.column(1), len(pivots)), centroids, near)
            for c in range(len(centroids)):
                mine = best == c
                total[c, 0] += mine.sum()
                total[c, 1:] += rows[mine].sum(axis=0)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, width + 1), pa.int32()),
                pa.array(np.tile(np.arange(-1, width), len(some)), pa.int32()), pa.array(total[some].ravel())
            ], names=["cluster", "at", "total"]
        )

    parts = table.select("v", "p").mapInArrow(run, "cluster int, at int, total long")
    return parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    near, width = pivot_rows(centroids, pivots), centroids.shape[1]
    kind = table.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(
                _matrix(batch.column(1), width), _matrix(batch.column(2), len(pivots)), centroids, near
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"]
            )

    return materialize(table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")


def cluster(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector
    (vec_id, embedding) after the last round. The first centroids are the vectors with the least
    SHA-256 of `seed:vec_id`."""
    rows = integers(vectors, how)
    name = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(name), "v").limit(max(how.k, how.sample)).select("v").collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not first:
        return rows.sparkSession.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    sample = np.array([r.v for r in first], np.int64)
    centroids, pivots = sample[: how.k].copy(), choose_pivots(sample, how.pivots)
    table = with_pivots(rows, pivots)
    for _ in range(how.rounds):
        found = {(r.cluster, r.at): int(r.total) for r in _sums(table, centroids, pivots)}
        for c, at in found:
            if at >= 0:
                centroids[c, at] = found[c, at] // found[c, -1]
    done = _assigned(table, centroids, pivots)
    inertia = {r.cluster: r.n for r in done.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.create_map(*(x for c in inertia for x in (F.lit(c), F.lit(values[c]))))[F.col("cluster")]
    return done.select(
        "vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256")
    )
