"""Clusters around centroids by exponion search, in exact integers.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of that
to all others. Where the bounds part strictly, nothing is searched. Else the bound is tightened, and
only centroids inside a ball around the vector's own are scanned: of radius twice the upper bound
plus the distance to the centroid's nearest neighbour, read off the centroid's sorted list of
distances. The ball holds the nearest centroid, all that tie with it, and the second nearest. Its
radius is inclusive and rounded up, so a tie is never missed.

Vectors and their bounds are a table in the shared folder, written anew each round, so nothing is
lost with an executor. What leaves the executors is a sum of moved vectors for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, record, session_of, stored

#: Components beyond this have squared distances that don't fit a long; below the other, sums of
#: products are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 22

#: Bounds are rounded away from each other by this share.
SLACK = 1e-9

#: Vectors that a kernel works on at once.
ROWS = 4096

_STATE = "vec_id long, vec binary, cluster int, was int, upper double, lower double"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The exact squared distances of all vectors to all centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and vectors.shape[1] <= 128:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Exponion:
    """Nearest centroids for vectors with bounds."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.next = self.apart[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)
        self.scanned = 0

    def _scan(self, vectors: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest of these centroids (ascending numbers, so the first of a tie), and both bounds."""
        far = squared(vectors, self.centroids[among])
        self.scanned += far.size
        best = np.argmin(far, axis=1)
        upper = np.sqrt(far[np.arange(len(far)), best].astype(np.float64))
        lower = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(np.float64)) if len(among) > 1 else np.full(len(far), np.inf)
        return among[best], upper * (1 + SLACK), lower * (1 - SLACK)

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) without bounds to begin with: all centroids are scanned."""
        return self._scan(vectors, np.arange(len(self.centroids)))

    def step(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) from bounds that hold for these centroids."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        open_ = self._open(np.arange(len(vectors)), cluster, upper, lower)
        upper[open_] = np.sqrt(self.own(vectors[open_], cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = self._open(open_, cluster, upper, lower)
        reach = (2 * upper[open_] + self.next[cluster[open_]]) * (1 + SLACK)
        held = cluster[open_]
        for a in np.unique(held).tolist():
            rows = open_[held == a]
            inside = np.searchsorted(self.apart[a], reach[held == a], side="right")
            # Balls of like size are scanned together: their numbers of centroids rounded up to powers of two.
            size = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64), len(self.centroids))
            for m in np.unique(size).tolist():
                own = rows[size == m]
                cluster[own], upper[own], lower[own] = self._scan(vectors[own], np.sort(self.order[a, :m]))
        return cluster, upper, lower

    def _open(self, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of these rows those whose centroid may not be the only nearest one."""
        return rows[~(upper[rows] < np.maximum(lower[rows], self.next[cluster[rows]] / 2 * (1 - SLACK)))]

    def own(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The exact squared distance to each vector's own centroid."""
        return ((vectors - self.centroids[cluster]) ** 2).sum(axis=1)


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after centroids moved so far: the own one's move widens the upper bound, the
    farthest of the others' lessens the lower one."""
    most = np.argmax(drift)
    second = np.partition(drift, -2)[-2] if len(drift) > 1 else 0.0
    others = np.where(cluster == most, second, drift[most])
    return (upper + drift[cluster]) * (1 + SLACK), lower - others * (1 + SLACK)


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): which rows hold ``dim`` finite components, none null, and floor(scale * x) of
    these. Vectors whose integers are beyond MOST are left out: their distances don't fit a long."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
        fine = (np.abs(x) <= MOST).all(axis=1)
    return rows[fine], x[fine].astype(np.int64)


def _packed(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * 4
    raw = np.ascontiguousarray(vectors, dtype="<i4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


@dataclass(frozen=True)
class Clusters:
    """``members`` has (vec_id, cluster, distance), the distance squared; ``centroids`` one row each."""

    members: DataFrame
    centroids: np.ndarray


def cluster_vectors(vectors: DataFrame, k: int, rounds: int, dim: int, scale: int, order: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Clusters vectors of ``dim`` components, each turned into the integer floor(scale * x).

    Centroids begin as the ``k`` vectors that ``order`` (a Column over vec_id) puts first; ties by
    the integers. Each round assigns all vectors to their nearest centroid, ties to the smaller
    number, and moves every centroid with members to floor(sum / count) of each component; empty
    ones stay. Then all are assigned once more.

    Null vectors, those of other lengths, with null or non-finite components or with integers
    beyond 2**27 take no part. With fewer than k vectors each is a centroid; a table without any
    gives no members. Rows that repeat an id, and equal vectors, count one by one. Other columns
    are not read.
    """
    session_of(vectors)
    spark = vectors.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = integers(batch.column("v"), dim, scale)
            yield record(["vec_id", "vec"], [batch.column("vec_id").take(pa.array(rows)), _packed(own)])

    base, last = Scratch(spark), Scratch(spark)
    now = base.stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(prepare, "vec_id long, vec binary"), "cluster-vectors")
    first = now.select(order.alias("o"), "vec").orderBy("o", "vec").limit(k).collect()  # k rows
    if not first:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64))
    centroids = np.stack([np.frombuffer(r["vec"], "<i4").astype(np.int64) for r in first])
    sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    drift = None
    for _ in range(rounds):
        now = last.stored(now.mapInArrow(_assignment(centroids, drift, dim), _STATE), "cluster-state")
        base.drop()
        base, last = last, base
        for row in _moves(now, len(centroids), dim).collect():  # k * (dim + 1) rows
            if row["pos"] == dim:
                counts[row["cluster"]] += int(row["total"])
            else:
                sums[row["cluster"], row["pos"]] += int(row["total"])
        after = np.array([[int(s) // int(n) for s in own] if n else c.tolist() for own, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
        drift = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64))
        centroids = after
    members = stored(now.mapInArrow(_assignment(centroids, drift, dim, final=True), "vec_id long, cluster int, distance long"), "cluster-members")
    base.drop()
    return Clusters(members, centroids)


def _assignment(centroids: np.ndarray, drift: np.ndarray | None, dim: int, final: bool = False):
    """Assigns the rows of a state, or of vectors alone in the first round, to these centroids."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = _unpacked(part.column("vec"), dim)
                if "cluster" in batch.schema.names:
                    was, upper, lower = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                    cluster, upper, lower = search.step(vectors, was, *moved_bounds(was, upper, lower, drift))
                else:
                    was = np.full(len(vectors), -1, np.int32)
                    cluster, upper, lower = search.first(vectors)
                cluster = pa.array(cluster.astype(np.int32))
                if final:
                    yield record(["vec_id", "cluster", "distance"], [part.column("vec_id"), cluster, search.own(vectors, cluster.to_numpy())])
                else:
                    yield record(["vec_id", "vec", "cluster", "was", "upper", "lower"], [part.column("vec_id"), part.column("vec"), cluster, pa.array(was, pa.int32()), upper, lower])

    return assign


def _moves(state: DataFrame, k: int, dim: int) -> DataFrame:
    """(cluster, pos, total): by how much each centroid's sums change, and at ``pos`` = dim its
    count, from the vectors that moved. Tasks sum their own rows first."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = _unpacked(part.column("vec"), dim)
                vectors = np.concatenate([vectors, np.ones((len(vectors), 1), np.int64)], axis=1)
                now, was = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "was"))
                np.add.at(total, now, vectors)
                np.subtract.at(total, was[was >= 0], vectors[was >= 0])
        own = np.flatnonzero(total.any(axis=1))
        if len(own):
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * (dim + 1), pa.array(total[own].ravel()))
            yield record(["cluster", "change"], [pa.array(own, pa.int32()), lists])

    changed = state.where("cluster <> was").select("vec", "cluster", "was").mapInArrow(move, "cluster int, change array<long>")
    return changed.select("cluster", F.posexplode("change").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))


def with_inertia(found: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the distances summed
    over each member's cluster and over all, and its centroid's digest."""
    spark = found.members.sparkSession
    own = {r["cluster"]: r["s"] for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, sum(own.values()), digest(found.centroids[c])) for c, s in sorted(own.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
