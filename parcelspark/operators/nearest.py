"""Exact cosine top-k between two vector tables.

Vectors are grouped around a few pivots, and near groups are filled into units of bounded size. Queries first search the
unit of their own group, which gives each of them a score its k-th hit cannot fall below; the angle between query and
pivot then rules whole groups out, and a query goes once to every other unit that is left. Within a task both sides are cut
into tiles and leaves of near vectors, and only leaves that can hold a better hit are multiplied, as small matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from parcelspark.functions.numbers import round_even
from parcelspark.operators.skew import salted_join, top_rows
from parcelspark.session import cut_lineage, ship_package

PIVOTS = 64
BLOCK = 2048  # rows of a side that meet in one matrix product, at most
UNIT_BYTES = 32 << 20  # vectors of a side that meet in one task, at most
LEAF, TILE = 256, 128  # near vectors that are ruled out together, near queries that look together
DIGITS = 9  # ranks are taken on scores rounded here, ties by id
SLACK = 1e-7  # of a bound on a cosine


def unit(vector: Column) -> Column:
    """L2-normalised array of doubles; a zero vector stays zero.

    The norm is bound by a one-element transform: named within the lambda, it would be summed anew for each component.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return F.get(scaled, F.lit(0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _ceilings(angles: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Largest cosine with a vector within ``radius`` of a centre at these angles."""
    return np.cos(np.maximum(angles - radius, 0.0))


def _lookup(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(index) + 1)


def _chunk(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def _near_rows(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in parts of at most ``most`` near ones, by halving along the component that varies most."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        some = rows[:: max(1, len(rows) // 4096)]
        values = x[rows, int(np.nan_to_num(x[some].var(axis=0)).argmax())]
        order = np.argpartition(values, len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return done


def _search(
    queries: np.ndarray, least: np.ndarray, data: np.ndarray, places: np.ndarray, wanted: int, block: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and of data and scores of the ``wanted`` best hits per query, and the score each query's last hit cannot fall below.

    ``least`` is what is known of that score before; hits below it are left out. Ties go to the lower of ``places``.
    """
    least = least.copy()
    found: list[tuple[np.ndarray, ...]] = []
    leaves = _near_rows(data, LEAF)
    order, begins = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
    data = data[order]
    centres = np.add.reduceat(data, begins[:-1], axis=0)
    size = np.sqrt((centres * centres).sum(axis=1))[:, None]
    centres = np.divide(centres, size, out=np.zeros_like(centres), where=size > 0)
    spread = np.arccos(np.clip(np.einsum("ij,ij->i", data, np.repeat(centres, np.diff(begins), axis=0)), -1.0, 1.0))
    radius = np.nan_to_num(np.maximum.reduceat(spread, begins[:-1]), nan=np.pi)
    for rows in _near_rows(queries, min(TILE, block)):
        q, kth = queries[rows], least[rows]
        ceiling = np.nan_to_num(_ceilings(_angles(q, centres), radius), nan=1.0)
        # the most promising leaves first; as many at once as a product may hold
        queue = np.argsort(-ceiling.max(axis=0), kind="stable")
        hits: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, many = 0, 1
        while at < len(queue):
            batch = queue[at : at + many]
            at, many = at + many, min(2 * many, max(1, block // LEAF))
            batch = batch[(ceiling[:, batch] >= kth[:, None] - SLACK).any(axis=0)]
            if not len(batch):
                continue
            near = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in batch])
            scores = q @ data[near].T
            if np.isneginf(kth).any() and len(near) > wanted:
                best = -np.partition(-np.nan_to_num(scores, nan=-2.0), wanted - 1, axis=1)[:, wanted - 1]
                kth = np.maximum(kth, np.where(best > -2.0, np.round(best, DIGITS), -np.inf))
            query, hit = np.nonzero(scores >= kth[:, None] - 10.0**-DIGITS)
            value = np.round(scores[query, hit], DIGITS)
            kept = value >= kth[query]
            query, hit, value = (np.concatenate(x) for x in zip(hits, (query[kept], near[hit[kept]], value[kept])))
            ranked = np.lexsort((places[order[hit]], -value, query))
            query, hit, value = query[ranked], hit[ranked], value[ranked]
            rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
            last = rank == wanted - 1
            kth[query[last]] = np.maximum(kth[query[last]], value[last])
            hits = tuple(x[rank < wanted] for x in (query, hit, value))
        least[rows] = kth
        found.append((rows[hits[0]], order[hits[1]], hits[2]))
    return *(np.concatenate(x) for x in zip(*found)), least


def topk_cosine(
    queries: DataFrame, data: DataFrame, query_id: str, data_id: str, vector: str, k: int,
    exclude_self: bool = False, pivots: int = PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """(query_id, data_id, score, rank) with the ``k`` best scores per query.

    Equal vectors are searched once: of each distinct vector only the smallest
    ids can appear in a result, so copies neither crowd a unit nor multiply the
    work. ``exclude_self`` drops the hit with the query's own id.
    """
    spark = queries.sparkSession
    ship_package(spark)
    wanted = k + 1 if exclude_self else k
    q = queries.select(F.col(query_id).alias("qid"), unit(F.col(vector)).alias("u"))
    d = data.select(F.col(data_id).alias("did"), unit(F.col(vector)).alias("u"))
    first = F.first("did").over(Window.partitionBy("u").orderBy(F.col("did").asc()).rowsBetween(Window.unboundedPreceding, 0))
    members = cut_lineage(top_rows(d.withColumn("rep", first), ["u"], [F.col("did").asc()], wanted, "_copy").select("rep", "did", "u", "_copy"))
    points = members.filter("_copy = 1").select("rep", "u")
    asked = cut_lineage(q.groupBy("u").agg(F.min("qid").alias("qrep"), F.count("*").alias("_n")))

    # ``pivots`` vectors reach the driver.
    chosen = points.orderBy(F.xxhash64("rep"), "rep").limit(pivots).collect()
    if not chosen:
        return q.select(F.col("qid").alias(query_id), F.lit(None).cast(data.schema[data_id].dataType).alias(data_id),
                        F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    centres = _chained(np.array([r["u"] for r in chosen]))
    n_pivots = len(centres)

    def placed(df: DataFrame, key: str) -> DataFrame:
        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    angle = _angles(_matrix(batch.column("u")), centres)
                    yield pa.RecordBatch.from_arrays([
                        *batch.columns, pa.array(angle.argmin(axis=1), pa.int32()), pa.array(angle.min(axis=1))], names=[key, "u", "cluster", "angle"])

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, "u").mapInArrow(assign, f"{key} {kind}, u array<double>, cluster int, angle double")

    located = cut_lineage(placed(points, "rep"))
    stats = {r["cluster"]: r for r in located.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    radius = np.nan_to_num([stats[c]["radius"] if c in stats else -1.0 for c in range(n_pivots)], nan=np.pi)
    sizes = [stats[c]["n"] if c in stats else 0 for c in range(n_pivots)]
    tasks = 2 * spark.sparkContext.defaultParallelism
    unit_rows = max(block, UNIT_BYTES // (8 * max(1, centres.shape[1])))
    # with fewer rows, units are smaller and more tasks have work
    first_unit, pieces = _units(sizes, min(unit_rows, max(block, max(sizes), sum(sizes) // tasks)))
    n_units = first_unit[-1] + pieces[-1]
    home = lambda key: _lookup(first_unit, "cluster") + _chunk(key, _lookup(pieces, "cluster"))
    stored = located.select("rep", "u", home("rep").alias("unit"))

    homes = cut_lineage(placed(asked, "qrep").select("qrep", "u", home("qrep").alias("unit")))
    dtype, qtype = points.schema["rep"].dataType, asked.schema["qrep"].dataType
    hit = T.ArrayType(T.StructType([T.StructField("rep", dtype), T.StructField("score", T.DoubleType())]))

    def meet(left: DataFrame, function, schema: T.StructType) -> DataFrame:
        """Bring bounded parts of the queries of a unit and the unit together."""
        load = {r["unit"]: r["n"] for r in left.groupBy("unit").agg(F.count("*").alias("n")).collect()}
        most = min(unit_rows, max(block, sum(load.values()) // tasks))
        parts = [max(1, -(-load.get(c, 0) // most)) for c in range(n_units)]
        right = stored.withColumn("part", F.explode(F.sequence(F.lit(0), _lookup(parts, "unit") - 1)))
        return left.withColumn("part", _chunk("qrep", _lookup(parts, "unit"))).groupBy("unit", "part").cogroup(
            right.groupBy("unit", "part")).applyInArrow(function, schema)

    def hits_of(n: int, right: pa.Table, query: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> pa.Array:
        """Hits as one list per query."""
        order = np.argsort(query, kind="stable")
        ends = np.cumsum(np.bincount(query, minlength=n))
        reps = right.column("rep").combine_chunks().take(pa.array(rows[order])) if right.num_rows else pa.nulls(0, right.schema.field("rep").type)
        return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays([reps, pa.array(scores[order])], ["rep", "score"]))

    def searched(u: np.ndarray, least: np.ndarray, right: pa.Table) -> tuple[np.ndarray, ...]:
        if not right.num_rows:
            return (none := np.zeros(0, np.int64)), none, np.zeros(0), least
        places = np.empty(right.num_rows, np.int64)
        places[pc.sort_indices(right.column("rep")).to_numpy()] = np.arange(right.num_rows)
        return _search(u, least, _matrix(right.column("u")), places, wanted, block)

    def at_home(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Hits in the own unit, and the other units that may hold better ones."""
        if not left.num_rows:
            return _empty(first_schema)
        u = _matrix(left.column("u"))
        query, rows, scores, least = searched(u, np.full(len(u), -np.inf), right)
        # A zero vector scores 0 everywhere, whatever its angle says.
        flat = (np.abs(u).sum(axis=1) == 0)[:, None] | (np.abs(centres).sum(axis=1) == 0)[None, :]
        visit = ((_ceilings(_angles(u, centres), radius) >= least[:, None] - SLACK) | flat) & (radius >= 0)
        other = np.zeros((len(u), n_units), bool)
        for c in range(n_pivots):
            other[:, first_unit[c] : first_unit[c] + pieces[c]] |= visit[:, c, None]
        other[:, key[0].as_py()] = False
        return pa.table({
            "qrep": left.column("qrep"), "u": left.column("u"), "least": pa.array(least), "hits": hits_of(len(u), right, query, rows, scores),
            "targets": pa.array([np.flatnonzero(x) for x in other], pa.list_(pa.int32()))})

    def elsewhere(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _empty(other_schema)
        u = _matrix(left.column("u"))
        query, rows, scores, _ = searched(u, left.column("least").to_numpy(), right)
        some = np.unique(query)
        return pa.table({
            "qrep": left.column("qrep").combine_chunks().take(pa.array(some)), "hits": hits_of(len(some), right, np.searchsorted(some, query), rows, scores)})

    first_schema = T.StructType([
        T.StructField("qrep", qtype), T.StructField("u", T.ArrayType(T.DoubleType())), T.StructField("least", T.DoubleType()),
        T.StructField("hits", hit), T.StructField("targets", T.ArrayType(T.IntegerType()))])
    other_schema = T.StructType([T.StructField("qrep", qtype), T.StructField("hits", hit)])
    visits = cut_lineage(meet(homes, at_home, first_schema))
    aimed = visits.select("qrep", "u", "least", F.explode("targets").alias("unit"))
    hits = visits.select("qrep", "hits").union(meet(aimed, elsewhere, other_schema))
    hits = hits.select("qrep", F.explode("hits").alias("_hit")).select("qrep", "_hit.rep", "_hit.score")
    order = [F.col("score").desc(), F.col("rep").asc()]
    top = top_rows(hits, ["qrep"], order, wanted, "_r").drop("_r")
    expanded = top.join(members.select("rep", "did"), "rep").select("qrep", "did", "score")
    # Copies of one query share its hits; the join back is salted on the shared vector.
    owners = salted_join(q, asked.drop("_n"), ["u"], ["qid"], counts=asked.select("u", "_n")).select("qid", "qrep")
    mine = top_rows(expanded, ["qrep"], [F.col("score").desc(), F.col("did").asc()], wanted, "_r").drop("_r")
    full = salted_join(owners, mine, ["qrep"], ["qid"])
    if exclude_self:
        full = full.filter(F.col("qid") != F.col("did"))
    ranked = top_rows(full.select("qid", "did", "score"), ["qid"], [F.col("score").desc(), F.col("did").asc()], k)
    return ranked.select(
        F.col("qid").alias(query_id), F.col("did").alias(data_id), round_even("score", 4).alias("score"), "rank")


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in a chain from near to near."""
    left, chain = list(range(1, len(pivots))), [0]
    while left:
        nearest = int(np.argmax(np.nan_to_num(pivots[left] @ pivots[chain[-1]], nan=-2.0)))
        chain.append(left.pop(nearest))
    return pivots[chain]


def _units(sizes: list[int], most: int) -> tuple[list[int], list[int]]:
    """First unit and number of units of every group: groups in order fill a unit up to ``most`` rows, a larger one is cut."""
    first, pieces, held = [], [], 0
    for n in sizes:
        cut = max(1, -(-n // most))
        if first and pieces[-1] == cut == 1 and held + n <= most:
            first.append(first[-1])
            held += n
        else:
            first.append(first[-1] + pieces[-1] if first else 0)
            held = n
        pieces.append(cut)
    return first, pieces


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
