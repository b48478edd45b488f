"""Resampling a corpus towards a target distribution by hashed n-gram importance.

Features are runs of one and two words, hashed into buckets. A bucket's gain is the
scaled log ratio of its smoothed share in the target and in the corpus; gains form one array
of fixed length that every task gets. A document's weight is the floored mean gain of its
features, and Gumbel noise from a hash of its id makes the highest scores a sample without
replacement.

The drawn documents are found without a global sort. Scores are persisted; jobs that
count rows above a few thresholds halve the interval of the cutoff score, and then that of
the doc_id among the rows tied at it. Only the drawn rows are dealt by range, numbered in their
part, and moved by the parts' sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from parcelspark.llm.textblocks import slices
from parcelspark.session import materialise

#: Thresholds counted by one job: three halvings at once.
PROBES = 7
#: A-Z to lower case; bytes that end words to blanks. Words are digits, a-z and all beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_in(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; none where the text is null."""
    return text.encode().translate(_WORDS).split() if text else []


def features(words: list[bytes]) -> list[int]:
    """Unsigned crc32 of every word and of every two neighbours joined by a blank."""
    ones = [crc32(word) for word in words]
    return ones + [crc32(word, crc32(b" ", first)) for first, word in zip(ones, islice(words, 1, None))]


def bucket_counts(texts: DataFrame, column: str, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; tasks add up first, ``buckets`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                found += features(words_in(text))
            total += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = texts.select(texts[column].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, in doubles."""
    size = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of an id, scaled and floored; a null id counts as empty text."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, least_words: int, seed: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_features, eligible, weight, score) of every row."""
    kind = docs.schema[id_column].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        raise TypeError("the cutoff is found by halving, so ids must be integers")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_features", T.LongType()), T.StructField("eligible", T.BooleanType()),
                           T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: list[int] = []
            words, ends = [], [0]
            for text in batch.column("text").to_pylist():
                own = words_in(text)
                found += features(own)
                words.append(len(own))
                ends.append(len(found))
            sums = np.append(0, np.cumsum(gain[np.array(found, np.int64) % buckets]))[ends]
            sizes, enough = np.diff(ends), np.array(words, np.int64) >= least_words
            weights = np.diff(sums) // np.maximum(sizes, 1)
            scores = [w + noise(i, seed) for w, i in zip(weights.tolist(), batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(enough, pa.bool_()),
                                              pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names=schema.names)

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, schema)


def _smallest(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """Smallest v in low..high with at least ``wanted`` rows of ``value`` <= v; high has that many.

    Every job counts exactly at PROBES inner points and so leaves an eighth of the interval.
    """
    while low < high:
        points = sorted({low + (high - low) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {high}) or [low]
        found = rows.agg(*[F.count(F.when(value <= p, 1)).alias(f"p{k}") for k, p in enumerate(points)]).first()
        reached = [p for k, p in enumerate(points) if found[k] >= wanted]
        missed = [p for k, p in enumerate(points) if found[k] < wanted]
        high = min(reached, default=high)
        low = max(missed) + 1 if missed else low
    return low


def cutoff(rows: DataFrame, wanted: int) -> Column:
    """Condition that holds for the first ``wanted`` rows by falling score, then rising doc_id, null ids last.

    Rows that repeat the last drawn score and id all pass it. Only counts and thresholds come to the driver.
    """
    if not wanted:
        return F.lit(False)
    rows = rows.filter("eligible")
    bounds = rows.agg(F.min("score"), F.max("score")).first()
    score = -_smallest(rows, -F.col("score"), -bounds[1], -bounds[0], wanted)
    tied = rows.filter(F.col("score") == score)
    above, ids, low, high = rows.agg(
        F.count(F.when(F.col("score") > score, 1)), F.count(F.when((F.col("score") == score), F.col("doc_id"))),
        F.min(F.when(F.col("score") == score, F.col("doc_id"))), F.max(F.when(F.col("score") == score, F.col("doc_id")))).first()
    left = wanted - above
    if left > ids:
        tie = F.lit(True)  # all ids, and null ones
    else:
        tie = F.coalesce(F.col("doc_id") <= _smallest(tied, F.col("doc_id"), low, high, left), F.lit(False))
    return F.col("eligible") & ((F.col("score") > score) | ((F.col("score") == score) & tie))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, 1 for the highest score, ties to the smaller doc_id, null ids last.

    Rows are dealt by ranges of that order, with the part they were written from behind it, so that
    repeats of one row need not stay together; each part is sorted and numbered, then moved by the rows before it.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("part")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema, T.StructField("piece", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, piece, np.int32)), pa.array(np.arange(before + 1, before + n + 1))], names=schema.names)
            before += n

    numbered = materialise(dealt.mapInArrow(number, schema), "resample-numbered")
    sizes = sorted((r.piece, r.n) for r in numbered.groupBy("piece").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for piece, n in sizes:
        offsets.append((piece, total))
        total += n
    moved = rows.sparkSession.createDataFrame(offsets, "piece int, rows_before long")  # one row per part
    return numbered.join(F.broadcast(moved), "piece").withColumn("rank", F.col("place") + F.col("rows_before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
             id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn, ties to
    the smaller id; ``rank`` is 1, 2, 3, ... in that order and null for the others. Null texts have no words:
    weight 0 and not drawn. Null ids count as empty text in the noise and come last among ties. Repeated rows are
    rows of their own; where only some repeats of one row are drawn, they are alike in all columns but the rank.
    Empty tables give no rows; an empty target only smooths. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_column, buckets), bucket_counts(target, target_column, buckets))
    rows = materialise(scored(docs, gain, least_words, seed, id_column, text_column).withColumn("part", F.spark_partition_id()), "resample-scores")
    wanted = percent * rows.filter("eligible").count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = cutoff(rows, wanted)
    first = ranked(rows.filter(drawn)).select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return first.unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
