"""Centroid clustering in exact integers with an incremental distance matrix.

Each vector keeps its squared length and its exact inner product with every centroid. When centroids
move, only the components that changed are multiplied into those products, and the nearest centroid
is found anew; |x - c|^2 = |x|^2 - 2 x.c + |c|^2. Sums per cluster are kept the same way: only
vectors that changed cluster are added and taken away. The state is written after every round in the
shared folder, so a lost executor repeats tasks of one round. The driver holds the centroids and
cluster sums: clusters x components numbers.

Rounds that would change nothing are left out, as all later ones would be equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelspark.session import drop_materialised, materialise

#: Largest absolute integer component: 64 squared differences of it stay within a long.
MOST = 1 << 27
STATE = "vec_id long, x array<int>, norm long, dots array<long>, cluster int, cluster_before int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(table: DataFrame, id_column: str, vector_column: str, width: int, scale: int) -> DataFrame:
    """(vec_id, x) of vectors with ``width`` finite components: floor(scale * component), in doubles.

    Others are left out. A component beyond MOST after scaling raises, as its distances are no longer exact longs.
    """
    vector = table[vector_column]
    good = (F.size(vector) == width) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = table.filter(F.coalesce(good, F.lit(False)))
    scaled = F.transform(kept[vector_column], lambda c: F.floor(c.cast("double") * float(scale)))
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) <= MOST, c.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact long distances")).cast("int")))
    return kept.select(kept[id_column].cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors of the smallest sha256 of seed:id; repeats of an id in order of their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(key, "x").limit(clusters).collect()], np.int64)


def _times(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact vectors x others; in double precision where every partial sum stays below 2**53."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(others).max(initial=0)) * max(vectors.shape[1], 1)
    if bound < 1 << 53:
        return (vectors.astype(np.float64) @ others.astype(np.float64)).astype(np.int64)
    return vectors @ others


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _rows(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def _nearest(dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Smallest |c|^2 - 2 x.c; argmin takes the smaller number among ties."""
    return np.argmin((centroids * centroids).sum(1) - 2 * dots, axis=1).astype(np.int32)


def _state(ids: pa.Array, x: pa.Array, norms: np.ndarray, dots: np.ndarray, cluster: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, x, pa.array(norms, pa.int64()), _rows(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(before, pa.int32())],
                                      names=["vec_id", "x", "norm", "dots", "cluster", "cluster_before"])


def first_state(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """All products with the first centroids."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            dots = _times(x, centroids.T)
            yield _state(batch.column("vec_id"), batch.column("x"), (x * x).sum(1), dots, _nearest(dots, centroids), np.full(len(x), -1, np.int32))

    return vectors.mapInArrow(run, STATE)


def next_state(state: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """Products moved by the changed components alone, and the nearest centroid of each vector again."""
    clusters, width = centroids.shape
    moved = [(k, np.flatnonzero(change[k])) for k in range(clusters) if change[k].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots = _matrix(batch.column("x"), width), _matrix(batch.column("dots"), clusters)
            for k, components in moved:
                dots[:, k] += _times(x[:, components], change[k, components][:, None])[:, 0]
            yield _state(batch.column("vec_id"), batch.column("x"), batch.column("norm").to_numpy(), dots, _nearest(dots, centroids), batch.column("cluster").to_numpy())

    return state.mapInArrow(run, STATE)


def moved_sums(state: DataFrame, clusters: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of every cluster's component sums and size since the last round, as Python integers.

    A task adds up its own vectors first: at most clusters x (components + 1) rows leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, width + 1), np.int64)
        for batch in batches:
            x = np.column_stack([_matrix(batch.column("x"), width), np.ones(batch.num_rows, np.int64)])
            for column, sign in (("cluster", 1), ("cluster_before", -1)):
                at = batch.column(column).to_numpy()
                np.add.at(total, at[at >= 0], sign * x[at >= 0])
        k, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(total[k, j], pa.int64())], names=["k", "j", "n"])

    parts = state.filter("cluster <> cluster_before").select("x", "cluster", "cluster_before").mapInArrow(run, "k int, j int, n long")
    out = np.zeros((clusters, width + 1), object)
    for row in parts.groupBy("k", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        out[row.k, row.j] = int(row.n)
    return out[:, :width], out[:, width]


def cluster(table: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3,
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors that are null, of another width, or hold null or non-finite components take no part. With fewer
    vectors than ``clusters`` each starts its own cluster. Repeated rows, also of one id, are vectors of their own; a
    null id counts as empty text in the start. Equal vectors go to the smaller centroid number. Empty tables
    give no rows. Other columns are not read. ``inertia`` sums that do not fit a long raise.
    """
    spark = table.sparkSession
    vectors = materialise(integer_vectors(table, id_column, vector_column, width, scale), "centroid-vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    clusters = len(centroids)
    state = materialise(first_state(vectors, centroids), "centroid-state")
    drop_materialised(vectors)
    sums, sizes = np.zeros((clusters, width), object), np.zeros(clusters, object)
    for _ in range(rounds):
        more, members = moved_sums(state, clusters, width)
        sums, sizes = sums + more, sizes + members
        wanted = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for row, n, old in zip(sums, sizes, centroids)], np.int64)
        change = wanted - centroids
        if not change.any():
            break
        centroids, old = wanted, state
        state = materialise(next_state(old, centroids, change), "centroid-state")
        drop_materialised(old)
    lengths = F.array(*[F.lit(int((c * c).sum())) for c in centroids])
    own = state.select("vec_id", "cluster", (F.col("norm") - 2 * F.get("dots", F.col("cluster")) + F.get(lengths, F.col("cluster"))).alias("distance"))
    inertias = {r.cluster: int(r.total) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(inertias.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(k, total, whole, digests[k]) for k, total in inertias.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
