"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

Each piece of a text begins as one symbol per byte in a linked list. A heap holds
(rank, position) of the adjacent pairs that can merge; the lowest is popped again and
again, the leftmost first. An entry whose pair has changed since is stale and skipped.
The count is the number of first symbols minus the number of merges. Equal pieces
of a task are merged once; the store of their counts is bounded.

Strings of added tokens inside a text count as one token each and cut the text, as
the tokenizers library does by default; nothing is added before or after a text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelspark.llm.pretoken import BETWEEN, piece_hashes, starts_of
from parcelspark.llm.textblocks import EMPTIERS, slices


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class MergeRules:
    """Merge ranks of a byte-level vocabulary file, and counts of pieces by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            stored = json.load(source)
        model, cut = stored["model"], stored["pre_tokenizer"] or {}
        plain = not (stored["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"))
        if not (plain and model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stored["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word borders")
        vocabulary = model["vocab"]
        self.letters = [vocabulary[letter] for letter in byte_letters()]
        self.size = max(vocabulary.values()) + 1
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: pair of symbols, as one number -> (rank, symbol of both)
        self.merges = {vocabulary[a] * self.size + vocabulary[b]: (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        specials = sorted((t["content"] for t in stored["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def count(self, piece: str) -> int:
        """Tokens of one piece: its bytes minus the merges that the ranks allow."""
        symbols = [self.letters[b] for b in piece.encode()]
        n, size, merges = len(symbols), self.size, self.merges
        if n < 2:
            return n
        heap = [(found[0], i) for i in range(n - 1) if (found := merges.get(symbols[i] * size + symbols[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = merges.get(symbols[i] * size + symbols[j])
            if found is None or found[0] != rank:
                continue  # stale
            done += 1
            symbols[i], symbols[j] = found[1], -1
            follow = after[i] = after[j]
            if follow < n:
                before[follow] = i
                found = merges.get(symbols[i] * size + symbols[follow])
                if found:
                    heapq.heappush(heap, (found[0], i))
            if (left := before[i]) >= 0:
                found = merges.get(symbols[left] * size + symbols[i])
                if found:
                    heapq.heappush(heap, (found[0], left))
        return n - done


class TextCounter:
    """Token counts of texts; every distinct piece is merged once. A store of ``most`` counts begins anew."""

    def __init__(self, rules: MergeRules, pattern: str, most: int = 500_000):
        self.rules, self.pattern, self.most = rules, regex.compile(pattern), most
        self.known: dict[int, int] = {}
        EMPTIERS.append(self.known.clear)

    def _runs(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text without added tokens; no text holds BETWEEN."""
        joined = BETWEEN.join(texts)
        if not joined.strip(BETWEEN):
            return np.zeros(len(texts), np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(starts_of(points))
        sizes = np.diff(np.append(begins, len(points)))
        between = points[begins] == ord(BETWEEN)
        text_of = np.cumsum(between)[~between]
        hashes = piece_hashes(points, begins, sizes)[~between]
        begins, sizes = begins[~between], sizes[~between]
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.known
        counts = np.fromiter((known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        for slot in np.flatnonzero(counts < 0).tolist():
            at = int(first[slot])
            counts[slot] = known[int(distinct[slot])] = self.rules.count(joined[begins[at] : begins[at] + sizes[at]])
        return np.bincount(text_of, weights=counts[inverse], minlength=len(texts)).astype(np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        special = self.rules.special
        total = np.zeros(len(texts), np.int64)
        parts, owners = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            cut = special.split(text) if special and special.search(text) else [text]
            total[at] += len(cut) - 1
            for part in cut:
                if BETWEEN in part:  # the letter between texts is taken: by the pattern itself
                    total[at] += sum(map(self.rules.count, self.pattern.findall(part)))
                elif part:
                    parts.append(part)
                    owners.append(at)
        if parts:
            np.add.at(total, owners, self._runs(parts))
        return total


_loaded: dict[tuple[str, str], TextCounter] = {}


def counter(path: str, pattern: str) -> TextCounter:
    """The counter of this process for a vocabulary file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TextCounter(MergeRules(path), pattern)
    return _loaded[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, one row per row.

    ``n_bytes`` is the UTF-8 size of the whole text, ``over_limit`` whether it has more than
    ``limit`` tokens. Null texts count as empty: 0 bytes, 0 tokens. Null and repeated ids
    keep their rows; other columns are not read; an empty table gives no rows. ``path`` must be
    readable on the executors; ``pattern`` cuts texts into pieces.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens = own.count(texts.to_pylist())
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())], names=schema.names)

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, schema)
