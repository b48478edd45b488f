"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

File format: a Parquet table of blocks in ascending document order. A block holds
whole documents: their ids and id counts, the block's place in its part, and the
coded ids as two byte streams. Ids are replaced by their rank in order of
falling frequency (``ranks`` table beside the blocks), so that frequent ids take one
byte. The control stream has two bits per id (bytes - 1), four ids to a byte; the
data stream has the bytes, lowest first. Decoding looks the four lengths of each
control byte up in a 256-row table and gathers the data bytes with array operations.

Parquet is the container because Spark's commit protocol then makes a retried task
leave each block once, in any store that Spark can write.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from parcelspark.llm.pretoken import BETWEEN, PieceEncoder
from parcelspark.llm.textblocks import ragged, slices

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1_000_000
#: Lengths of the four ids of each control byte.
LENGTHS = np.array([[1 + (byte >> shift & 3) for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative integers below 2**32."""
    values = values.astype(np.uint32)
    sizes = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        longer = sizes > k
        data[starts[longer] + k] = values[longer] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Inverse of ``pack`` for ``count`` values."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32) if count else np.zeros(0, np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        if len(longer):
            out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryPieces:
    """Ids of distinct pieces from the tokenizers library.

    Pieces of a blank and something solid are cut alike when they stand one
    after the other, so they are encoded as running text and told apart by their bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.bytes_of[number] = len(token)  # one letter of the byte alphabet per byte
        self.specials = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, pieces: list[str], run: int = 400) -> tuple[np.ndarray, np.ndarray]:
        running = np.array([len(p) > 1 and p[0] == " " and not p[1].isspace() for p in pieces], bool)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        alone = np.flatnonzero(~running).tolist()
        for at, found in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
            ids[at] = np.array(found.ids, np.uint32)
        order = np.flatnonzero(running).tolist()
        groups = [order[i : i + run] for i in range(0, len(order), run)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)):
            all_ids = np.array(found.ids, np.uint32)
            ends = np.cumsum(self.bytes_of[all_ids])
            wanted = np.cumsum([len(pieces[i].encode()) for i in group])
            cuts = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cuts - 1], wanted):
                raise ValueError("an id crosses pieces: the vocabulary does not split text by this pattern")
            for at, part in zip(group, np.split(all_ids, cuts[:-1])):
                ids[at] = part
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


_loaded: dict[str, tuple[LibraryPieces, PieceEncoder]] = {}


def loaded(path: str) -> tuple[LibraryPieces, PieceEncoder]:
    """Tokenizer and piece store of this process."""
    if path not in _loaded:
        library = LibraryPieces(path)
        _loaded[path] = library, PieceEncoder(library)
    return _loaded[path]


def library_ids(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids as the library gives them without special tokens, and each text's number of ids."""
    library, encoder = loaded(path)
    odd = {i for i, t in enumerate(texts) if t and (BETWEEN in t or any(s in t for s in library.specials))}
    ids, counts = encoder.encode([t if t and i not in odd else "" for i, t in enumerate(texts)])
    if not odd:
        return ids, counts
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for i in odd:
        parts[i] = library.whole(texts[i])
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def encode_with_library(docs: DataFrame, path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, ids) of every document, ids with ``end_id`` behind; two bytes each where the vocabulary allows."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("width", T.IntegerType()),
        T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, counts = library_ids(batch.column("text").to_pylist(), path)
            width = 2 if max(loaded(path)[0].size, end_id) < 1 << 16 else 4
            full = np.empty(len(ids) + len(counts), f"<u{width}")
            ends = np.cumsum(counts + 1)
            last = np.zeros(len(full), bool)
            last[ends - 1] = True
            full[last], full[~last] = end_id, ids
            raw = memoryview(full.tobytes())
            cuts = [0, *(ends * width).tolist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(counts), width, np.int32)),
                pa.array([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=schema.names)

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, schema)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a batch, and each row's number."""
    widths = batch.column("width").to_numpy(zero_copy_only=False)
    parts = [np.frombuffer(raw, f"<u{w}") for raw, w in zip(batch.column("ids").to_pylist(), widths.tolist())]
    return np.concatenate(parts).astype(np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text and write blocks and ranks below ``folder``, in ascending order of the id column.

    A null text counts as empty and has only the end id; a null document id stands first.
    Repeated rows are all written, equal document ids in the order of their ids' bytes.
    An empty table leaves files without blocks. Other columns are not read. Texts are encoded once:
    the ids go to a table in ``folder`` from which frequencies are counted and blocks made.
    """
    spark = docs.sparkSession
    encode_with_library(docs, path, end_id, id_column, text_column).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            more = np.bincount(_ids(batch)[0], minlength=len(total))
            more[: len(total)] += total
            total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counted = encoded.select("width", "ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row per id of the vocabulary
    by_rank = [row.id for row in counted.orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame(list(enumerate(by_rank)), "rank int, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    ranks = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    ranks[np.array(by_rank, np.int64)] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(ranks)

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(encoded.schema["doc_id"].dataType)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for number, batch in enumerate(slices(batches, "ids", 2 * BLOCK_IDS)):
            ids, counts = _ids(batch)
            control, data = pack(shared.value[ids])
            offsets = pa.array([0, len(counts)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(offsets, batch.column("doc_id")), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=schema.names)
            start += len(ids)

    (encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(blocks, schema)
     .write.option("compression", "zstd").parquet(f"{folder}/blocks"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids (uint32, little-endian), ids_crc32.

    ``start`` counts the ids of all documents before it. The driver sees one sum
    per part and the ranks of the vocabulary.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = {row.part: row.n for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, before = {}, 0
    for part in sorted(totals):
        bases[part], before = before, before + totals[part]
    table = np.array([row.id for row in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast((bases, table))
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, table = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("part", "start", "n_ids", "control", "data")}
                counts = batch.column("counts")[k].values.to_numpy(zero_copy_only=False)
                ids = table[unpack(row["control"].as_py(), row["data"].as_py(), row["n_ids"].as_py())]
                raw, cuts = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * np.cumsum(counts)).tolist()]
                parts = [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[k].values,
                    pa.array(bases[row["part"].as_py()] + row["start"].as_py() + np.cumsum(counts) - counts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=schema.names)

    return blocks.mapInArrow(run, schema)
