"""Byte-level pre-tokens of many texts at once, and an encoder that works once per distinct piece.

The piece boundaries follow the public splitting pattern of byte-level BPE
vocabularies. Code points are classed by table, boundaries are found with array
comparisons over all texts of a slice, and equal pieces share one encoding.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import regex

from parcelspark.llm.textblocks import EMPTIERS, MIX, mix, ragged

LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4
#: Noncharacter that stands between texts; texts that hold it take the plain way.
BETWEEN = chr(0x10FFFF)
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and 64-bit hash of every code point, made once per process."""
    if not _tables:
        kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, every):
                a, b = ord(every[found.start()]), ord(every[found.end() - 1])
                kinds[a : b + 1] = kind
        kinds[WHITE_SPACE] = SPACE
        kinds[ord(BETWEEN)] = BREAK
        _tables["kinds"] = kinds
        _tables["hashes"] = mix(mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * MIX))
        powers = np.empty(1 << 16, np.uint64)
        powers[0] = 1
        _tables["powers"] = np.multiply.accumulate(np.concatenate([powers[:1], np.full(len(powers) - 1, 0xD1342543DE82EF95, np.uint64)]))
    return _tables["kinds"], _tables["hashes"]


def code_point_classes() -> np.ndarray:
    """Class of every code point."""
    return _classes()[0]


def starts_of(points: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a pre-token begins; BREAK is a piece of its own."""
    kinds = _classes()[0][points]
    n = len(kinds)
    before = np.concatenate([np.array([BREAK], np.uint8), kinds[:-1]])
    after = np.concatenate([kinds[1:], np.array([BREAK], np.uint8)])
    blank = points == 32
    blank_before = np.concatenate([np.zeros(1, bool), blank[:-1]])
    solid, space = kinds < SPACE, kinds == SPACE
    solid |= kinds == OTHER
    solid_after = (after < SPACE) | (after == OTHER)
    # a run begins where the class changes, but a blank before it belongs to it
    starts = (kinds != before) & ~(solid & blank_before)
    starts |= kinds == BREAK
    # the last white space before something solid stands apart from its run
    starts |= space & solid_after
    # an apostrophe that begins a piece takes one of the fixed endings with it
    marks = np.flatnonzero((points == 39) & (before != OTHER) & ~blank_before & (after == LETTER))
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        last = -1
        for m in marks.tolist():
            if m < last:
                continue
            one, two = int(padded[m + 1]), int(padded[m + 2])
            size = 2 if one in (115, 116, 109, 100) else 3 if (one, two) in ((114, 101), (118, 101), (108, 108)) else 0
            if size:
                last = m + size
                starts[m + 1 : m + size] = False
                if last < n and not space[last]:
                    starts[last] = True
    return starts


def piece_hashes(points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of every piece: sum of code-point hashes times powers of an odd number."""
    _, hashes = _classes()
    powers = _tables["powers"]
    place = np.arange(len(points), dtype=np.int64) - np.repeat(begins, sizes)
    terms = hashes[points] * powers[place & 0xFFFF] + (place >> 16).astype(np.uint64) * MIX
    return mix(np.add.reduceat(terms, begins) + sizes.astype(np.uint64) * MIX)


class PieceEncoder:
    """Token ids of texts; ``encode_pieces`` is asked once for every distinct piece.

    ``encode_pieces(list[str])`` returns (ids of all pieces one after the other,
    number of ids of each). ``most`` bounds the memory: a fuller store begins anew.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode_pieces, self.most = encode_pieces, most
        self._clear()
        EMPTIERS.append(self._clear)

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.offsets, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, pieces: int, ids: int) -> None:
        for name, need in (("offsets", pieces), ("counts", pieces), ("ids", ids)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have) // 2), have.dtype)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids. No text holds BETWEEN."""
        if len(self.known) > self.most:
            self._clear()
        joined = BETWEEN.join(texts)
        counts = np.zeros(len(texts), np.int64)
        if not joined.strip(BETWEEN):
            return np.zeros(0, np.uint32), counts
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(starts_of(points))
        sizes = np.diff(np.append(begins, len(points)))
        text_of = np.cumsum(points[begins] == ord(BETWEEN))
        real = points[begins] != ord(BETWEEN)
        hashes = piece_hashes(points, begins, sizes)
        begins, sizes, hashes, text_of = begins[real], sizes[real], hashes[real], text_of[real]
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.known
        slots = np.fromiter((known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = first[new]
            pieces = [joined[a:b] for a, b in zip(begins[at].tolist(), (begins[at] + sizes[at]).tolist())]
            ids, lengths = self.encode_pieces(pieces)
            base = len(known)
            self._room(base + len(new), self.used + len(ids))
            self.offsets[base : base + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.counts[base : base + len(new)] = lengths
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            slots[new] = np.arange(base, base + len(new))
            known.update(zip(distinct[new].tolist(), range(base, base + len(new))))
        chosen = slots[inverse]
        lengths = self.counts[chosen].astype(np.int64)
        counts = np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64)
        return self.ids[ragged(self.offsets[chosen], lengths)], counts
