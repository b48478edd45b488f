"""Helpers shared by the text operators: bounded slices, word ids, hashes, splits."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Text handled at once in a task, in bytes; a single longer text forms its own slice.
SLICE_BYTES = 1_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)


#: Called at the end of a task: they empty the stores of a process, as Spark keeps its Python workers.
EMPTIERS: list[Callable[[], None]] = []


def tidy() -> None:
    """Empty all stores and give free memory back to the machine."""
    for empty in EMPTIERS:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``most`` bytes, or one row; frees memory behind the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin, total = np.cumsum(sizes), 0, 0
        while begin < batch.num_rows:
            stop = max(int(np.searchsorted(ends, total + most, side="right")), begin + 1)
            yield batch.slice(begin, stop - begin)
            begin, total = stop, int(ends[stop - 1])
    tidy()


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    values = (values ^ (values >> np.uint64(32))) * MIX
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
