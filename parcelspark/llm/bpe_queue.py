"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every merge rank has a bucket of positions in a linked list of symbols; a
three-level bitmap tells which buckets hold anything, and find-first-set on it
gives the next rank. Merging leaves old bucket entries in place: an entry whose
pair has changed is stale and skipped when its bucket is opened. One queue serves
all new pieces of a slice, as merges never cross pieces, so a very long piece
costs time in proportion to its length times the levels of the bitmap.

Order: lowest rank first, leftmost first. Within a bucket all entries are merged
together, overlapping ones from the left. That equals one-by-one order unless
a merge makes a pair of a lower or equal rank; for ranks where the vocabulary allows
that, each piece merges only its leftmost entry before the queue is asked again.

Null and empty texts have no ids. Every byte value must be in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelspark.llm.pretoken import BETWEEN, PieceEncoder
from parcelspark.llm.textblocks import ragged, slices


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _ordered(positions: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    positions = np.sort(positions)
    return positions[np.append(True, positions[1:] != positions[:-1])] if len(positions) > 1 else positions


class RankQueue:
    """Set of integers below ``size`` as a bitmap of 64-bit words under two summary levels."""

    def __init__(self, size: int):
        self.words = [0] * ((size >> 6) + 1)
        self.middle = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        self.words[rank >> 6] &= ~(1 << (rank & 63))
        if not self.words[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.middle[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def first(self) -> int:
        """Lowest member, -1 if empty: find-first-set on each level."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        word = self.middle[high]
        mid = high << 6 | (word & -word).bit_length() - 1
        word = self.words[mid]
        return mid << 6 | (word & -word).bit_length() - 1


class ByteBPE:
    """Ranks of a vocabulary as arrays: pair table, token bytes, and the encoder."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values, self.careful = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
                    # merging this pair after its later-ranked part goes back to a lower rank
                    self.careful.update(part for part in (left, right) if part >= rank)
        order = np.argsort(np.array(keys, np.int64))
        self.slots = 1 << (max(len(keys), 1) * 4).bit_length()
        self.keys = np.full(self.slots, -1, np.int64)
        self.values = np.full(self.slots, self.size, np.int64)
        self._fill(np.array(keys, np.int64)[order], np.array(values, np.int64)[order])
        lengths = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.token_bytes = np.frombuffer(b"".join(token for token, _ in by_rank), np.uint8)
        self.token_sizes = lengths
        self.token_starts = np.cumsum(lengths) - lengths

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing, one probe step at a time for all keys that still have no slot."""
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            at, firsts = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[firsts]
            self.keys[at], self.values[at] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, place = keys[rest], values[rest], (place[rest] + 1) % self.slots

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, ``size`` where the two do not merge."""
        keys = left * self.size + right
        place = self._place(keys)
        out = np.full(len(keys), self.size, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            place[open_] = (place[open_] + 1) % self.slots
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and each piece's number of ids."""
        raw = [piece.encode() for piece in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbols)
        piece = np.repeat(np.arange(len(raw)), sizes)
        # linked list: n marks the end, pairs across pieces never merge
        after = np.arange(1, n + 1)
        after[np.cumsum(sizes)[sizes > 0] - 1] = n
        before = np.arange(-1, n - 1)
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        pair = np.full(n + 1, self.size, np.int64)  # rank of (symbol, next symbol); stale entries differ from it
        linked = np.flatnonzero(after < n)
        pair[linked] = self.pair_ranks(symbols[linked], symbols[after[linked]])
        queue, buckets = RankQueue(self.size + 1), defaultdict(list)

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            good = ranks < self.size
            positions, ranks = positions[good], ranks[good]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(positions, cuts), ranks[np.append(0, cuts)].tolist()):
                if rank not in buckets:
                    queue.add(rank)
                buckets[rank].append(part)

        put(linked, pair[linked])
        alive = np.ones(n, bool)
        while (rank := queue.first()) >= 0:
            queue.remove(rank)
            entries = buckets.pop(rank)
            at = entries[0] if len(entries) == 1 else np.concatenate(entries)
            at = _ordered(at[pair[at] == rank])  # skips stale entries
            if not len(at):
                continue
            if rank in self.careful:
                keep = np.append(True, piece[at][1:] != piece[at][:-1])
                put(at[~keep], np.full(int((~keep).sum()), rank))
                at = at[keep]
            elif len(at) > 1:
                # in a chain of overlapping pairs every second one merges, from the left
                chained = np.append(False, after[at[:-1]] == at[1:])
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                odd = (np.arange(len(at)) - head) & 1 == 1
                at = at[~odd]
            right = after[at]
            follow = after[right]
            symbols[at], after[at] = rank, follow
            alive[right], pair[right] = False, self.size
            inner = follow < n
            before[follow[inner]] = at[inner]
            pair[at] = self.size
            near = at[inner]
            left = before[at]
            touched = _ordered(np.concatenate([near, left[left >= 0]]))
            if len(touched):
                pair[touched] = self.pair_ranks(symbols[touched], symbols[after[touched]])
                put(touched, pair[touched])
        counts = np.bincount(piece[alive], minlength=len(raw))
        return symbols[alive].astype(np.uint32), counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and each id's number of bytes."""
        sizes = self.token_sizes[ids]
        return self.token_bytes[ragged(self.token_starts[ids], sizes)], sizes


_loaded: dict[str, tuple[ByteBPE, PieceEncoder]] = {}


def loaded(path: str) -> tuple[ByteBPE, PieceEncoder]:
    """Vocabulary and piece store of this process."""
    if path not in _loaded:
        model = ByteBPE(read_ranks(path))
        _loaded[path] = model, PieceEncoder(model.encode_pieces)
    return _loaded[path]


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's number of ids."""
    _, encoder = loaded(path)
    texts = [text or "" for text in texts]
    if not any(BETWEEN in text for text in texts):
        return encoder.encode(texts)
    # a text that holds the separator is cut there; the separator itself is a symbol run, so the pattern decides
    import public_tokenizers
    import regex

    ids, counts = [], []
    for text in texts:
        if BETWEEN in text:
            found, sizes = encoder.encode_pieces(regex.findall(public_tokenizers.PATTERN, text))
        else:
            found, sizes = encoder.encode([text])
        ids.append(found)
        counts.append(int(sizes.sum()))
    return np.concatenate(ids), np.array(counts, np.int64)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids`` (little-endian uint32) and ``decoded`` bytes digests.

    Returns doc_id, the columns ``keep``, n_tokens, ids, ids_sha256, decoded_sha256. A null
    text counts as empty: no ids, digests of nothing. Repeated rows each give a row;
    other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), *(docs.schema[name] for name in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = loaded(path)
        for batch in slices(batches, "text"):
            ids, counts = encode_texts(batch.column("text").to_pylist(), path)
            raw, sizes = model.decode(ids)
            ends = np.cumsum(counts)
            byte_ends = np.append(0, np.cumsum(sizes))[np.append(0, ends)]
            packed, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
            bounds = np.append(0, ends)
            parts = [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            texts = [plain[a:b] for a, b in zip(byte_ends[:-1].tolist(), byte_ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(batch.column(name) for name in keep), pa.array(counts, pa.int64()), pa.array([bytes(p) for p in parts], pa.binary()),
                pa.array([hashlib.sha256(p).hexdigest() for p in parts]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                names=schema.names)

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"), *keep).mapInArrow(run, schema)
