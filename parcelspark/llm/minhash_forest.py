"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. One pass over the texts gives every document its number of shingles, a key of its word sequence, a signature and,
   for each tree, the hash of the first ``DEPTHS[0]`` values of the tree's own signature order.
   Documents of one word sequence are one class from here on, with the smallest id standing for it.
2. Classes that share the first values in a tree are a region: their longest common prefix is at least that depth.
   A region of up to LEAF classes compares all of them by signature. A larger one goes to the next depth, so the
   depth adapts to the region; before it is cut, all its members are compared to its hub, the member
   that agrees most with the region's most frequent values. Pairs whose signatures reach the threshold less
   three standard errors are candidates: a spanning forest and each member's two best partners.
3. Candidates are confirmed on the full shingle sets of the two documents, and links joined to components.
4. Every first region, small or large, is then searched in full, in cells of two blocks: the members whose signature reaches the
   threshold less three standard errors with one of another component are named, and their cell compares their full sets
   by a matrix product. A cell gives only links that join components, fewer than it has members; no pairs leave it.
   The work still grows with the square of a region whose members stay apart, over BLOCK; rows a cell reads are at most 2 * BLOCK.
5. What signatures can miss is found exactly: all shingles have one order, rarer ones first by counts in hashed buckets, and two sets that
   reach the threshold share one of the first n - ceil(n * threshold) + 1 of each. Classes of different components that share such
   a shingle are compared by its places, which bound the intersection, and by a very loose test of signatures (LOOSE), and the pairs left
   are confirmed on full sets. The order decides on the work only, not on the links.

No group is gathered: hot regions are cut by depth, hubs are found by partial aggregation, and a hot word sequence is
one class. Regions that no depth can cut have equal signatures and are linked to their smallest member.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from parcelspark.llm.graph import components
from parcelspark.llm.textblocks import mix, slices, words_of
from parcelspark.session import drop_materialised, materialise

TREES, VALUES = 16, 128
#: Prefix lengths at which regions are cut; the last is the whole signature.
DEPTHS = (6, 9, 13, 18, 26, 40, 64, VALUES)
LEAF, SAMPLE = 64, 48
#: Members of a block of a region that is searched in full, about.
BLOCK = 256
#: Members of a region that a task of a join takes, about.
LANE = 1024
#: Shingles of a cell that are multiplied at a time.
STRIP = 4096
#: Buckets in which shingles are counted for their order, a fixed size.
COUNTED = 1 << 16
#: Holders of a shingle on the other side of a lane of a join of step 5, about.
WIDE = 16 * BLOCK
#: A pair of step 5 whose signatures agree in less than the threshold less this is not fetched: by Hoeffding's bound
#: exp(-2 * VALUES * LOOSE ** 2), once in 4e13 pairs at the threshold, which is rarer than equal hashes of different shingles.
LOOSE = 0.35
#: Documents whose sets are fetched are broadcast as a list of ids up to this number.
BROADCAST_IDS = 500_000

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
#: Order of the signature values in each tree; the first ones of different trees differ as far as possible.
ORDERS = np.array([np.concatenate([(np.arange(8) + 8 * tree) % VALUES, _random.permutation(np.setdiff1d(np.arange(VALUES), (np.arange(8) + 8 * tree) % VALUES))]) for tree in range(TREES)])


def shingle_rows(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Shingle hashes in text order, repeats included, and the word-sequence key of every text; no words, empty row and key."""
    table = defaultdict(count().__next__)
    rows, keys = [], []
    for text in texts:
        words = words_of(text)
        rows.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else b"")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, len(table))
    found = []
    for row in rows:
        own = hashes[row]
        n = len(own)
        if not n:
            found.append(own)
            continue
        span = min(width, n)
        value = np.full(n - span + 1, span, np.uint64)
        for k in range(span):
            value = mix(value ^ own[k : n - span + 1 + k])
        found.append(value)
    return found, keys


def shingle_sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct shingle hashes and the word-sequence key of every text; no words, empty set and key."""
    rows, keys = shingle_rows(texts, width)
    return [np.unique(row) for row in rows], keys


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)


def bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Number of shingles of all texts (doc_id, text) in each of the COUNTED buckets of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in slices(batches, "text"):
            rows, _ = shingle_rows(batch.column("text").to_pylist(), width)
            total += np.bincount(_bucket(np.concatenate(rows)), minlength=COUNTED)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "n": pa.array(total[full], pa.int64())})

    out = np.zeros(COUNTED, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most COUNTED rows
        out[row.bucket] = row.n
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, rarest bucket first: a set that reaches ``percent`` with it has one of them among its own first ones."""
    n = len(shingles)
    return shingles[np.argsort(counts[_bucket(shingles)], kind="stable")[: n - -(-percent * n // 100) + 1]]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x VALUES) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k, factor in enumerate(FACTORS):
        spread = flat * factor
        out[:, k] = np.minimum.reduceat(((spread ^ (spread >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32), starts)
    return out


def prefix_keys(signature: np.ndarray, tree: np.ndarray | int, depth: int) -> np.ndarray:
    """Hash of the first ``depth`` values of each row in its tree's order."""
    chosen = np.take_along_axis(signature, np.broadcast_to(ORDERS[tree][..., :depth], (len(signature), depth)), 1).astype(np.uint64)
    value = np.broadcast_to(np.asarray(tree, np.uint64) * np.uint64(1009) + np.uint64(depth), (len(signature),)).copy()
    for k in range(depth):
        value = mix(value ^ chosen[:, k])
    return value.astype(np.int64)


def _matrix(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.uint32).reshape(len(raws), VALUES)


def described(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, key, signature, regions, prefix) of (doc_id, text). ``counts`` are those of ``bucket_counts``."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("signature", T.BinaryType()), T.StructField("regions", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, keys = shingle_sets(batch.column("text").to_pylist(), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            raws: list[bytes | None] = [None] * len(sets)
            regions: list[list[int] | None] = [None] * len(sets)
            firsts: list[np.ndarray | None] = [None] * len(sets)
            if full:
                found = signatures([sets[k] for k in full])
                tops = np.column_stack([prefix_keys(found, tree, DEPTHS[0]) for tree in range(TREES)])
                for k, row, top in zip(full, found, tops):
                    raws[k], regions[k], firsts[k] = row.tobytes(), top, prefix(sets[k], held.value, percent).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()),
                pa.array(regions, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _leaf_pairs(signature: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Candidate pairs of a leaf: a spanning forest by falling agreement, and each member's two best partners."""
    n = len(signature)
    agree = np.zeros((n, n), np.float32)
    for k in range(n):
        agree[k] = (signature == signature[k]).mean(1)
    left, right = np.nonzero(np.triu(agree >= least, 1))
    order = np.argsort(-agree[left, right], kind="stable")
    root, kept, degree = list(range(n)), [], [0] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in order.tolist():
        a, b = int(left[at]), int(right[at])
        ra, rb = find(a), find(b)
        if ra != rb or degree[a] < 2 or degree[b] < 2:
            root[ra] = rb
            degree[a] += 1
            degree[b] += 1
            kept.append((a, b))
    return kept


def first_level(classes: DataFrame) -> DataFrame:
    """(tree, region, doc_id, signature, n) of the regions of n > 1 classes. ``classes`` has (doc_id, signature, regions)."""
    spots = classes.select("doc_id", F.posexplode("regions").alias("tree", "region"))
    shared = spots.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    return materialise(spots.join(shared, "region").join(classes.select("doc_id", "signature"), "doc_id").select("tree", "region", "doc_id", "signature", "n"), "forest-level")


def candidates(level: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of class ids, a < b, from all trees. ``level`` is that of ``first_level``."""
    id_type = level.schema["doc_id"].dataType
    pair = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    member = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("region", T.LongType()), T.StructField("doc_id", id_type), T.StructField("signature", T.BinaryType())])
    found = []

    def leaf(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids = rows.column("doc_id")
        pairs = _leaf_pairs(_matrix(rows.column("signature").to_pylist()), least)
        return pa.table({"a": ids.take(pa.array([p[0] for p in pairs], pa.int64())), "b": ids.take(pa.array([p[1] for p in pairs], pa.int64()))})

    def frequent(key: tuple, rows: pa.Table) -> pa.Table:
        values = np.sort(_matrix(rows.column("signature").to_pylist()), axis=0)
        runs = np.zeros(values.shape, np.int32)
        for k in range(1, len(values)):
            runs[k] = np.where(values[k] == values[k - 1], runs[k - 1] + 1, 0)
        return pa.table({"region": pa.array([key[0].as_py()], pa.int64()), "middle": pa.array([values[runs.argmax(0), np.arange(VALUES)].tobytes()], pa.binary())})

    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (_matrix(batch.column(name).to_pylist()) for name in ("signature", "middle"))
            columns = {name: batch.column(name) for name in ("region", "doc_id", "signature")}
            yield pa.RecordBatch.from_pydict(columns | {"agree": pa.array((own == other).mean(1), pa.float64())})

    def to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (_matrix(batch.column(name).to_pylist()) for name in ("signature", "middle"))
            close = pa.array((own == other).mean(1) >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column("doc_id").filter(close), "b": batch.column("hub").filter(close)})

    for depth in DEPTHS[1:]:
        found.append(level.filter(F.col("n") <= LEAF).groupBy("region").applyInArrow(leaf, pair))
        large = level.filter(F.col("n") > LEAF)
        if not large.limit(1).count():
            break
        # the most frequent values come from about SAMPLE members, the hub from all
        dealt = F.pmod(F.xxhash64("doc_id", "region"), F.ceil(F.col("n") / SAMPLE)) == 0
        middles = materialise(large.filter(dealt).select("region", "signature").groupBy("region").applyInArrow(frequent, "region long, middle binary"), "forest-middle")
        agreed = large.join(middles, "region").select("region", "doc_id", "signature", "middle").mapInArrow(
            agreement, T.StructType([member["region"], member["doc_id"], member["signature"], T.StructField("agree", T.DoubleType())]))
        best = agreed.groupBy("region").agg(F.max(F.struct("agree", "doc_id", "signature")).alias("top"))
        hubs = materialise(best.select("region", F.col("top.doc_id").alias("hub"), F.col("top.signature").alias("middle")), "forest-hubs")
        found.append(large.join(hubs, "region").select("doc_id", "signature", "hub", "middle").mapInArrow(to_hub, pair))

        def deeper(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    tree = batch.column("tree").to_numpy()
                    keys = prefix_keys(_matrix(batch.column("signature").to_pylist()), tree, depth)
                    yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array(keys), batch.column("doc_id"), batch.column("signature")], names=member.names)

        cut = large.select("tree", "doc_id", "signature").mapInArrow(deeper, member)
        cut = materialise(cut, "forest-cut")
        shared = cut.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
        level = materialise(cut.join(shared, "region").select("tree", "region", "doc_id", "signature", "n"), "forest-level")
    else:
        found.append(level.filter(F.col("n") <= LEAF).groupBy("region").applyInArrow(leaf, pair))
        alike = level.filter(F.col("n") > LEAF)
        found.append(alike.join(alike.groupBy("region").agg(F.min("doc_id").alias("hub")), "region").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    return every.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _partnered(rows: pa.Table, least: float) -> pa.Table:
    """Members of a cell that agree in at least ``least`` with one of another label: within the block, or on the other side if there are two blocks.

    A pair that an earlier tree holds in a region too is left to that region.
    """
    rows = rows.sort_by("doc_id")
    signature = _matrix(rows.column("signature").to_pylist())
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    within = rows.column("first")[0].as_py() == rows.column("second")[0].as_py()
    side = rows.column("side").to_numpy()
    earlier = ORDERS[: rows.column("tree")[0].as_py(), : DEPTHS[0]]
    found = np.zeros(len(signature), bool)
    for k in range(len(signature)) if within else np.flatnonzero(side == 0).tolist():
        others = np.arange(k + 1, len(signature)) if within else np.flatnonzero(side == 1)
        others = others[label[others] != label[k]]
        others = others[(signature[others] == signature[k]).mean(1) >= least]
        if len(others) and len(earlier):
            others = others[~(signature[others][:, earlier] == signature[k][earlier]).all(2).any(1)]
        if len(others):
            found[k] = found[others] = True
    return rows.select(["region", "first", "second", "doc_id", "label"]).filter(pa.array(found))


def _joining_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links of a cell that join different labels, at most one less than its labels, by the sizes of all intersections of its full sets."""
    rows = rows.sort_by("doc_id")
    sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in rows.column("shingles")]
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = (times > 1)[column]
    member, column = np.repeat(np.arange(len(sets)), sizes)[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int((times > 1).sum()), STRIP):
        low, high = np.searchsorted(column, (start, start + STRIP))
        strip = np.zeros((len(sets), STRIP), np.float32)
        strip[member[low:high], column[low:high] - start] = 1
        both += (strip @ strip.T).astype(np.int64)
    linked = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (label[:, None] != label)
    root, kept = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in zip(*(side.tolist() for side in np.nonzero(np.triu(linked, 1)))):
        one, other = find(int(label[left])), find(int(label[right]))
        if one != other:
            root[one] = other
            kept.append((left, right))
    ids = rows.column("doc_id")
    return pa.table({"a": ids.take(pa.array([p[0] for p in kept], pa.int64())), "b": ids.take(pa.array([p[1] for p in kept], pa.int64()))})


def partnered(level: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(region, first, second, doc_id, label): the cells of the regions of ``level`` with their members that agree in at least ``least`` with one of another component.

    ``labels`` has (node, label); a class without a label is its own component. The members of a region's largest component are not
    compared with each other. The others, in blocks, meet each other and its blocks, each two blocks in a cell of their own.
    No pairs leave a cell: a member is named once in each of its cells.
    """
    id_type = level.schema["doc_id"].dataType
    spots = level.select("region", "doc_id", "n").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    parts = spots.groupBy("region", "label").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("region").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda size: F.ceil(size / BLOCK)
    # large regions are dealt over lanes, so that no task of the join holds one
    lanes = F.ceil(F.col("n") / LANE)
    mixed = mixed.select("region", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1)).alias("lane"), F.col("top.label").alias("main"),
                         blocks(F.col("top.size")).alias("main_blocks"), blocks(F.col("n") - F.col("top.size")).alias("rest_blocks"))
    rows = spots.withColumn("lane", F.pmod(F.xxhash64("doc_id"), lanes)).join(mixed, ["region", "lane"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "region"), F.when(F.col("label") == F.col("main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))))

    def cell(first: Column, second: Column, side: Column) -> Column:
        return F.struct(first.cast("long").alias("first"), second.cast("long").alias("second"), side.cast("int").alias("side"))

    block, each = F.col("block"), lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
    cells = (F.when(F.col("n") <= BLOCK, F.array(cell(F.lit(0), F.lit(0), F.lit(0))))
             .when(F.col("label") == F.col("main"), F.transform(each("rest_blocks"), lambda r: cell(r, -1 - block, F.lit(1))))
             .otherwise(F.concat(F.transform(each("rest_blocks"), lambda r: cell(F.least(block, r), F.greatest(block, r), r < block)),
                                 F.transform(each("main_blocks"), lambda m: cell(block, -1 - m, F.lit(0))))))
    rows = rows.select("region", "doc_id", "label", F.explode(cells).alias("cell")).select("region", "doc_id", "label", "cell.*")
    rows = rows.join(level.select("region", "doc_id", "tree", "signature"), ["region", "doc_id"])
    member = T.StructType([T.StructField("region", T.LongType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType()),
                           T.StructField("doc_id", id_type), T.StructField("label", id_type)])
    return rows.groupBy("region", "first", "second").applyInArrow(lambda table: _partnered(table, least), member)


def joining_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within the cells of ``members`` (see ``partnered``), confirmed there on full sets; in a cell at most one less than its members."""
    id_type = members.schema["doc_id"].dataType
    held = shingles_of(members.select("doc_id"), docs, width)
    pair = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    return members.join(held, "doc_id").groupBy("region", "first", "second").applyInArrow(lambda table: _joining_links(table, percent), pair)


def contested(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(shingle, doc_id, label, n, room): the prefix shingles of ``classes`` (doc_id, n_shingles, prefix) that classes of several components hold.

    ``room`` is the size of the set from this shingle on. ``labels`` as in ``partnered``.
    """
    own = classes.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    spots = own.select("doc_id", "label", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "shingle"))
    holders = Window.partitionBy("shingle")
    mixed = F.min("label").over(holders) != F.max("label").over(holders)
    return spots.select("shingle", "doc_id", "label", "n", (F.col("n") - F.col("at")).alias("room"), mixed.alias("mixed")).filter("mixed").drop("mixed")


def prefix_pairs(spots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components of ``spots`` (see ``contested``) that can reach ``percent`` by the places of a shared shingle.

    The first shingle that two sets share leaves room for their whole intersection, so no pair that reaches ``percent`` is lost. The members
    of a shingle's largest component are not compared with each other. The other members meet all of them, both sides dealt over lanes.
    """
    parts = spots.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("shingle").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("holders"))
    mixed = mixed.select("shingle", F.col("top.label").alias("main"), F.ceil((F.col("holders") - F.col("top.size")) / BLOCK).alias("lefts"), F.ceil(F.col("holders") / WIDE).alias("rights"))
    held = spots.join(mixed, "shingle")
    lane = lambda name: F.pmod(F.xxhash64("doc_id", "shingle"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    side = lambda own: [F.col(name).alias(f"{own}_{name}") for name in ("doc_id", "label", "n", "room")]
    left = held.filter("label <> main").select("shingle", *side("a"), lane("lefts").alias("left"), every("rights").alias("right"))
    right = held.select("shingle", *side("b"), "main", lane("rights").alias("right"), every("lefts").alias("left"))
    c = F.col
    once = (c("a_label") != c("b_label")) & ((c("b_label") == c("main")) | (c("a_doc_id") < c("b_doc_id")))
    enough = (100 + percent) * F.least("a_room", "b_room") >= percent * (c("a_n") + c("b_n"))
    return (left.join(right, ["shingle", "left", "right"]).filter(once & enough)
            .select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct())


def plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures in ``classes`` (doc_id, signature) agree in at least ``least``; of several signatures of one id any will do."""
    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_matrix(batch.column(name).to_pylist()) for name in ("left", "right"))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(1) >= least))

    side = lambda own, name: classes.select(F.col("doc_id").alias(own), F.col("signature").alias(name))
    met = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
    return met.mapInArrow(agreeing, pairs.select("a", "b").schema).distinct()


def shingles_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents of ``ids`` (doc_id, may repeat): the hashes of their full sets."""
    id_type = docs.schema["doc_id"].dataType
    nodes = materialise(ids.distinct(), "forest-nodes")
    few = nodes.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, _ = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "shingles"])

    found = texts.mapInArrow(sets, T.StructType([T.StructField("doc_id", id_type), T.StructField("shingles", T.BinaryType())]))
    # of several texts of one id the set that is greatest as bytes, whatever the order of tasks
    return materialise(found.groupBy("doc_id").agg(F.max("shingles").alias("shingles")), "forest-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on their documents' full shingle sets, with ``similarity``."""
    id_type = docs.schema["doc_id"].dataType
    held = shingles_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar, linked = [], []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                linked.append(100 * both >= percent * union)
                similar.append(both / union if union else 0.0)
            linked = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(linked), "b": batch.column("b").filter(linked), "similarity": pa.array(similar, pa.float64()).filter(linked)})

    side = lambda own, name: held.select(F.col("doc_id").alias(own), F.col("shingles").alias(name))
    return (pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
            .mapInArrow(compare, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("similarity", T.DoubleType())])))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are cut at ASCII white space after lower-casing A-Z; a set holds distinct shingles of ``width`` words, of a shorter
    text its whole sequence. component_id is the smallest id reachable over links, kept marks the document that has it. A text that is null or
    has no words has an empty set and is linked with nothing. Repeated rows each give a row (with the same component); a null id is linked with
    nothing else and kept. Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    seen = materialise(described(texts, width, percent, bucket_counts(texts, width)), "forest-documents")
    full = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(full.groupBy("key").agg(F.min(F.struct("doc_id", "signature", "regions", "n_shingles", "prefix")).alias("first")).select("key", "first.*"), "forest-classes")
    slack = 3 * (percent / 100 * (1 - percent / 100) / VALUES) ** 0.5
    level = first_level(classes)
    pairs = materialise(candidates(level, percent / 100 - slack), "forest-pairs")
    links = materialise(confirmed(pairs, texts, width, percent), "forest-links")
    labels = components(links)
    members = materialise(partnered(level, labels, percent / 100 - slack), "forest-members")
    every = links.select("a", "b")
    old = [level, pairs, links, members]
    if members.limit(1).count():
        more = materialise(joining_links(members, texts, width, percent), "forest-more")
        every = every.union(more)
        labels = components(every)
        old.append(more)
    spots = materialise(contested(classes, labels), "forest-contested")
    near = materialise(prefix_pairs(spots, percent), "forest-near")
    missed = materialise(plausible(near, classes, percent / 100 - LOOSE), "forest-missed")
    late = materialise(confirmed(missed, texts, width, percent), "forest-late")
    if late.limit(1).count():
        labels = components(every.union(late.select("a", "b")))
    for done in (*old, spots, near, missed, late):
        drop_materialised(done)
    of_class = classes.join(labels, classes["doc_id"] == labels["node"], "left").select("key", F.coalesce("label", "doc_id").alias("label"))
    rows = seen.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
