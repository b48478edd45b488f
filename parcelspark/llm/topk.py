"""Exact top-k by inner product: tiled matrix products, partial selection, tree merging.

Vectors are packed into shards, queries into tiles. Every (tile, shard) pair is
one matrix product of bounded size in which only the k best per query survive.
The per-query lists of a tile are merged level by level, ``FAN`` lists at a time, so
no task ever sees more than FAN lists of a tile. The shards, which are the
larger side, are read once per tile of ``tile_rows`` queries.

Integer scores: products run in double precision where every partial sum stays
below 2**53, else in 64-bit integers, which must hold the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Candidate lists merged by one task.
FAN = 32
#: Rows of a shard multiplied at once.
PANEL = 4096

PACKED = "block long, width int, size int, ids binary, matrix binary"
LISTS = "tile long, shard long, query_ids binary, ids binary, scores binary"
#: Stands for "no candidate" in a list that is not full.
NONE = np.iinfo(np.int64).max


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """Rows of a group as one row of id and component bytes; equal rows count once."""
    ids = table.column("id").to_numpy()
    width = len(table.column("q")[0])
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    both = np.unique(np.column_stack([ids, flat.reshape(-1, width)]), axis=0)
    size = 2 if max(both[:, 1:].max(), -1 - both[:, 1:].min()) < 1 << 15 else 8  # bytes a component needs
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([width], pa.int32()), "size": pa.array([size], pa.int32()),
                     "ids": pa.array([both[:, 0].tobytes()], pa.binary()),
                     "matrix": pa.array([both[:, 1:].astype(f"<i{size}").tobytes()], pa.binary())})


def _product(queries: np.ndarray, panel: np.ndarray) -> np.ndarray:
    """Exact integer scores of every query and panel row."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(panel).max(initial=0)) * queries.shape[1]
    if bound < 1 << 24:
        return (queries.astype(np.float32) @ panel.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ panel.astype(np.float64).T).astype(np.int64)
    return queries @ panel.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, ties to the smaller id; ids NONE are no candidates."""
    if scores.shape[1] > 4 * k:
        # all that reach the k-th best score stay, so ties are decided by id below
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        most = int((scores >= kth).sum(1).max())
        if most < scores.shape[1]:
            keep = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _lists(tile: int, shard: int, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict:
    return {"tile": pa.array([tile], pa.int64()), "shard": pa.array([shard], pa.int64()),
            "query_ids": pa.array([query_ids.tobytes()], pa.binary()), "ids": pa.array([np.ascontiguousarray(ids).tobytes()], pa.binary()),
            "scores": pa.array([np.ascontiguousarray(scores).tobytes()], pa.binary())}


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, q): floor(256 x) of every component; vectors that are null, empty or hold null, NaN or infinity go."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return (vectors.select(F.col(id_column).cast("long").alias("id"), x.alias(vector_column))
            .filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
            .select("id", F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("q")))


def top_products(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 4096, tile_rows: int = 1024) -> DataFrame:
    """Best ``k`` vectors of every query: query_id, rank, vec_id, score.

    Both tables have (id long, q array<long>). Candidates are all vectors but those of the query's own
    id; a query with fewer candidates gets all. Ties go to the smaller id. Vectors of another
    length than the query's are no candidates. Equal rows count once; one id with different vectors is several
    candidates, and as a query keeps the best of all its vectors. Empty tables give no rows.
    """
    widths = vectors.groupBy(F.size("q").alias("width")).count().collect()  # one row per length in use
    n_shards = max(1, -(-sum(row["count"] for row in widths) // shard_rows))
    n_tiles = max(1, -(-queries.count() // tile_rows))
    # ids are dealt by hash; the block number carries the vector length, so lengths never mix
    length = F.shiftleft(F.size("q").cast("long"), 32)
    shards = (vectors.withColumn("block", length + F.pmod(F.xxhash64("id"), F.lit(n_shards)))
              .groupBy("block").applyInArrow(_pack, PACKED))
    tiles = (queries.withColumn("block", length + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_tiles)))
             .groupBy("block").applyInArrow(_pack, PACKED))
    # each tile's queries are sent to SPREAD join keys, over which its shards are dealt
    spread = max(1, min(n_shards, 64))
    left = shards.select(F.col("block").alias("shard"), "width", F.col("size").alias("s_size"), F.col("ids").alias("s_ids"), F.col("matrix").alias("s_matrix"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("n"), F.pmod("block", F.lit(spread)).alias("lane"))
    right = tiles.select(F.col("block").alias("tile"), "width", F.col("size").alias("t_size"), F.col("ids").alias("t_ids"), F.col("matrix").alias("t_matrix"),
                         F.pmod("block", F.lit(1 << 32)).cast("int").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("lane"))
    pairs = left.join(right, ["width", "n", "lane"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()
                width = get("width")
                query_ids, own = np.frombuffer(get("t_ids"), np.int64), np.frombuffer(get("s_ids"), np.int64)
                wanted = np.frombuffer(get("t_matrix"), f"<i{get('t_size')}").astype(np.int64).reshape(-1, width)
                rows = np.frombuffer(get("s_matrix"), f"<i{get('s_size')}").astype(np.int64).reshape(-1, width)
                ids, scores = np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0), np.int64)
                for at in range(0, len(own), PANEL):
                    panel = own[at : at + PANEL]
                    found = _product(wanted, rows[at : at + PANEL])
                    same = query_ids[:, None] == panel[None, :]
                    found[same] = np.iinfo(np.int64).min + 1
                    there = np.where(same, NONE, panel[None, :])
                    some, which = _best(found, there, k)
                    scores, ids = _best(np.hstack([scores, some]), np.hstack([ids, which]), k)
                yield pa.RecordBatch.from_pydict(_lists(get("tile"), get("shard"), query_ids, ids, scores))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        query_ids = np.frombuffer(table.column("query_ids")[0].as_py(), np.int64)
        read = lambda name: np.hstack([np.frombuffer(x, np.int64).reshape(len(query_ids), -1) for x in table.column(name).to_pylist()])
        scores, ids = _best(read("scores"), read("ids"), k)
        return pa.table(_lists(key[0].as_py(), key[1].as_py(), query_ids, ids, scores))

    lists = pairs.select("width", "tile", "t_size", "t_ids", "t_matrix", "shard", "s_size", "s_ids", "s_matrix").mapInArrow(products, LISTS)
    lists = lists.withColumn("shard", F.pmod("shard", F.lit(1 << 32)))
    level = n_shards
    while level > 1:
        lists = (lists.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("tile", "shard").applyInArrow(merge, LISTS))
        level = -(-level // FAN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query_ids = np.frombuffer(batch.column("query_ids")[row].as_py(), np.int64)
                ids, scores = (np.frombuffer(batch.column(name)[row].as_py(), np.int64).reshape(len(query_ids), -1) for name in ("ids", "scores"))
                # a query id with several vectors keeps its best rows
                who = np.repeat(query_ids, ids.shape[1])
                order = np.lexsort((ids.ravel(), -scores.ravel(), who))
                who, what, score = who[order], ids.ravel()[order], scores.ravel()[order]
                real = what != NONE
                who, what, score = who[real], what[real], score[real]
                first = np.append(True, who[1:] != who[:-1]) if len(who) else np.zeros(0, bool)
                rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0)) + 1
                keep = rank <= k
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(who[keep], pa.int64()), "rank": pa.array(rank[keep], pa.int32()),
                    "vec_id": pa.array(what[keep], pa.int64()), "score": pa.array(score[keep], pa.int64())})

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
