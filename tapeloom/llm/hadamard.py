"""Centroid clustering by Walsh-Hadamard progressive search.

A vector's components become integers, floor(SCALE * x), and an exact integer Walsh-Hadamard transform turns them into
64 coefficients, coarse (few sign changes) to fine. The transform keeps distances: the squared differences of all
coefficients of two vectors sum to 64 times their squared distance. So a sum over the first coefficients is a lower
bound. For each vector the coefficients are added up stage by stage (STAGES); the centroid that leads after the first
stage is finished at once, and its whole sum is a bound: centroids whose sum so far is strictly above it leave. Those
left after the last stage have all 64 coefficients, and the least sum wins, ties the smaller number. No centroid that
could win or tie ever leaves, so the result is that of a plain search.

Centroids (at most ``k`` rows of 64 integers) are all that the driver sees: a round sums each cluster inside the tasks,
adds the sums up by a groupBy, and divides them exactly. Vectors are read again each round, nothing is cached.

Defined results: vectors that are null, have not 64 components, or a null or non-finite one take no part and return no
row. Rows without an id are assigned and counted, but start no centroid. Repeated rows are rows of their own; of equal
ids the least vector starts first. Fewer than ``k`` rows give fewer clusters; an empty table gives no rows. Components
of 2^24 / SCALE or more have no exact sums here and raise an error. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stash

DIM = 64
#: Fixed values of the contract: the factor of the quantisation, clusters, rounds, and the salt of the starting order.
SCALE, CLUSTERS, ROUNDS, SALT = 64, 16, 3, "1:"
#: Coefficients that are known after each stage.
STAGES = (4, 8, 16, 32, DIM)
LIMIT = 1 << 24
BLOCK = 8192


def transform_matrix(dim: int = DIM) -> np.ndarray:
    """The Walsh-Hadamard matrix with its rows by number of sign changes, coarse to fine."""
    h = np.ones((1, 1), np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


_H = transform_matrix()


def usable(vec: Column) -> Column:
    """True for a vector of DIM finite components; never null."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) == DIM) & whole, F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; x is taken as a double."""
    q = np.floor(values.astype(np.float64) * scale)
    if len(q) and np.abs(q).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT} or more after scaling by {scale}: its sums would not be exact")
    return q.astype(np.int64)


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return quantised(flat.to_numpy(zero_copy_only=False).reshape(-1, DIM), SCALE)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every point, both exact."""
    cluster, distance = np.empty(len(points), np.int32), np.empty(len(points), np.int64)
    c = centroids @ _H.T
    for at in range(0, len(points), BLOCK):
        p = points[at : at + BLOCK] @ _H.T
        part = ((p[:, None, : STAGES[0]] - c[None, :, : STAGES[0]]) ** 2).sum(2)
        row, number = (x.ravel() for x in np.indices(part.shape))
        lead = part.argmin(1)
        bound = ((p - c[lead]) ** 2).sum(1)
        part = part.ravel()
        for done, upto in zip(STAGES, STAGES[1:], strict=False):
            stay = part <= bound[row]
            row, number, part = row[stay], number[stay], part[stay]
            part = part + ((p[row, done:upto] - c[number, done:upto]) ** 2).sum(1)
        order = np.lexsort((number, part, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        cluster[at : at + BLOCK], distance[at : at + BLOCK] = number[first], part[first] // DIM
    return cluster, distance


@dataclass(frozen=True)
class Centroids:
    """Rows of whole numbers; the row's place is the centroid's number."""

    rows: tuple[tuple[int, ...], ...]

    def array(self) -> np.ndarray:
        return np.array(self.rows, np.int64).reshape(-1, DIM)


def start(vectors: DataFrame, *, k: int = CLUSTERS, id_col: str = "vec_id", vec_col: str = "embedding") -> Centroids:
    """The k usable vectors whose salted ids have the smallest hashes."""
    named = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    h = F.sha2(F.concat(F.lit(SALT), F.col(id_col).cast("string")).cast("binary"), 256)
    first = named.select(h.alias("h"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return Centroids(tuple(tuple(quantised(np.array(r["v"]), SCALE).tolist()) for r in first))


def assign(vectors: DataFrame, centroids: Centroids, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every usable vector."""

    def run(batches):
        c = centroids.array()
        for b in batches:
            if b.num_rows:
                cluster, distance = nearest(_matrix(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(distance)], names=[id_col, "cluster", "distance"])

    kept = vectors.where(usable(F.col(vec_col))).select(id_col, vec_col)
    return kept.mapInArrow(run, kept.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema)


def improve(vectors: DataFrame, centroids: Centroids, *, vec_col: str = "embedding") -> Centroids:
    """The centroids after one round: exact floored means of what each is nearest to; one without vectors stays."""
    k = len(centroids.rows)

    def run(batches):
        c, n, total = centroids.array(), np.zeros(k, np.int64), np.zeros((k, DIM), object)
        for b in batches:
            if b.num_rows:
                points = _matrix(b.column(0))
                cluster, _ = nearest(points, c)
                n += np.bincount(cluster, minlength=k)
                for i in np.unique(cluster).tolist():
                    total[i] += points[cluster == i].sum(0)
        own = np.flatnonzero(n)
        sums = pa.array([[Decimal(int(x)) for x in total[i]] for i in own], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), sums], names=["cluster", "n", "total"])

    parts = vectors.where(usable(F.col(vec_col))).select(vec_col).mapInArrow(run, "cluster int, n long, total array<decimal(38,0)>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(DIM))).alias("total"))
    moved = {r["cluster"]: tuple(int(x) // r["n"] for x in r["total"]) for r in whole.collect()}  # k rows
    return Centroids(tuple(moved.get(i, row) for i, row in enumerate(centroids.rows)))


def cluster(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Centroids]:
    """(id, cluster, distance, cluster_inertia, inertia) of every usable vector, and the last centroids."""
    centroids = start(vectors, k=k, id_col=id_col, vec_col=vec_col)
    for _ in range(rounds):
        centroids = improve(vectors, centroids, vec_col=vec_col)
    found = stash(assign(vectors, centroids, id_col=id_col, vec_col=vec_col), "clusters")
    sums = found.groupBy(F.col("cluster").alias("__c")).agg(F.sum("distance").alias("cluster_inertia"))
    sums = F.broadcast(sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))))  # k rows, by construction
    return found.join(sums, F.col("cluster") == F.col("__c")).drop("__c"), centroids


def digest(centroids: Centroids, number: Column) -> Column:
    """sha256 of a centroid's components as decimal integers with commas between."""
    texts = F.array(*(F.lit(",".join(map(str, row))) for row in centroids.rows)) if centroids.rows else F.array(F.lit(None).cast("string"))
    return F.sha2(F.get(texts, number).cast("binary"), 256)
