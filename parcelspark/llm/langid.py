"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Training has two steps. One pass over all training texts counts, for every hashed
n-gram, the documents that hold it (the IDF), and keeps the n-gram counts of a
bounded sample of rows. The regression is fitted to the sample by
follow-the-regularised-leader with elastic-net penalties, and a temperature is set
on a part of the sample that the fit has not seen. Prediction is one pass of array code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from parcelspark.llm import pretoken
from parcelspark.llm.textblocks import slices
from parcelspark.session import drop_materialised, materialise

ORDERS = (1, 2, 3)
BITS = 14
#: Rows that the regression is fitted to, at most about; a bound of the method.
SAMPLE_ROWS = 6000
#: A letter by Unicode; number signs such as one half or a Roman eight are none.
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def gram_counts(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Counts of every text's hashed n-grams; letters are lower-cased, all else is a blank."""
    lowered = [text.lower() for text in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    kinds = pretoken.code_point_classes()
    points = np.where(kinds[points] == pretoken.LETTER, points, np.uint32(32))
    codes, state = [], np.zeros(len(points), np.uint32)
    for order in range(1, max(orders) + 1):
        shifted = points[order - 1 :]
        state = (state[: len(shifted)] * np.uint32(0x9E3779B1) + shifted + np.uint32(1)) * np.uint32(0x85EBCA6B)
        state = state ^ (state >> np.uint32(15))
        if order in orders:
            codes.append((order, (state * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int32)))
    begin = 0
    for text in lowered:
        end = begin + len(text)
        parts = [code[begin : max(end - order + 1, begin)] for order, code in codes]
        yield np.bincount(np.concatenate(parts), minlength=1 << bits)
        begin = end


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for rows of n-gram counts."""
        return _softmax((_unit(counts * self.idf) @ self.weights + self.bias) / self.temperature)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, n_labels: int, epochs: int = 4,
             alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal over mini-batches of sparse count rows."""
    size = len(idf)
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))

    def weights() -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            dense = np.zeros((len(chosen), size + 1))
            for k, row in enumerate(chosen):
                dense[k, rows[row][0]] = rows[row][1]
            dense[:, :size] = _unit(dense[:, :size] * idf)
            dense[:, size] = 1
            w = weights()
            p = _softmax(dense @ w)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            g = dense.T @ p
            more = g * g
            z += g - (np.sqrt(n + more) - np.sqrt(n)) / alpha * w
            n += more
    w = weights()
    return w[:size], w[size]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least negative log-likelihood, from a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Model from the rows whose text and label are not null. No such rows: a model without languages.

    Document frequencies cover all rows; the regression sees those rows whose hash of id and text
    falls in the share that makes about ``sample_rows`` of them.
    """
    rows = docs.select(docs[id_column].cast("string").alias("id"), docs[text_column].alias("text"), docs[label_column].alias("label")).dropna(subset=["text", "label"])
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)))
    limit = int(share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches, "text"):
            places, labels = batch.column("place").to_pylist(), batch.column("label").to_pylist()
            kept = {"place": [], "label": [], "grams": [], "counts": []}
            for k, counts in enumerate(gram_counts(batch.column("text").to_pylist())):
                there = np.flatnonzero(counts)
                seen[there] += 1
                if places[k] <= limit:
                    for name, value in zip(kept, (places[k], labels[k], there.astype(np.int32).tobytes(), counts[there].astype(np.int32).tobytes())):
                        kept[name].append(value)
            if kept["place"]:
                yield pa.RecordBatch.from_arrays([
                    pa.array(kept["place"], pa.int64()), pa.array(kept["label"], pa.string()), pa.array(kept["grams"], pa.binary()),
                    pa.array(kept["counts"], pa.binary()), pa.nulls(len(kept["place"]), pa.int32()), pa.nulls(len(kept["place"]), pa.int64())], names=names)
        grams = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(grams), pa.int64()), pa.nulls(len(grams), pa.string()), pa.nulls(len(grams), pa.binary()),
            pa.nulls(len(grams), pa.binary()), pa.array(grams, pa.int32()), pa.array(seen[grams], pa.int64())], names=names)

    schema = "place long, label string, grams binary, counts binary, gram int, docs long"
    names = [part.split()[0] for part in schema.split(", ")]
    counted = materialise(rows.mapInArrow(count, schema), "langid")
    frequency = np.zeros(1 << BITS)
    for row in counted.filter("gram is not null").groupBy("gram").agg(F.sum("docs").alias("docs")).collect():  # one row per hashed n-gram
        frequency[row.gram] = row.docs
    sample = counted.filter("gram is null").collect()  # about sample_rows rows
    drop_materialised(counted)
    sample.sort(key=lambda row: (row.place, row.label, row.grams, row.counts))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    languages = sorted({row.label for row in sample})
    if not languages:
        return LanguageModel([], idf, np.zeros((len(idf), 0)), np.zeros(0), 1.0)
    number = {language: k for k, language in enumerate(languages)}
    labels = np.array([number[row.label] for row in sample])
    sparse = [(np.frombuffer(row.grams, np.int32), np.frombuffer(row.counts, np.int32)) for row in sample]
    held = np.arange(len(sample)) % 5 == 4
    fit_on = np.flatnonzero(~held)
    weights, bias = fit_ftrl([sparse[k] for k in fit_on], labels[fit_on], idf, len(languages))
    logits = np.array([_unit((np.bincount(g, c, len(idf)) * idf)[None])[0] @ weights + bias for g, c in (sparse[k] for k in np.flatnonzero(held))])
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, labels[held]))


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The input's columns with ``lang_pred`` and ``score``, the probability of that language.

    A text that is null or has no letter, and any text under a model without languages,
    is undetermined with score 0. Input columns of these two names are replaced. Rows stay as they are.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows, one column per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        idf, weights, bias = model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias.astype(np.float32)
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            known = [k for k, text in enumerate(texts) if model.languages and text and LETTER.search(text)]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows, at = np.zeros((128, len(idf)), np.float32), []

            def settle() -> None:
                dense = rows[: len(at)]
                norms = np.sqrt(np.einsum("ij,ij->i", dense, dense))[:, None]
                p = _softmax((dense @ weights / np.maximum(norms, 1e-12) + bias).astype(np.float64) / model.temperature)
                best = p.argmax(1)
                for k, b, s in zip(at, best.tolist(), p.max(1).tolist()):
                    names[k], scores[k] = model.languages[b], s
                at.clear()

            for k, counts in zip(known, gram_counts([texts[k] for k in known])):
                np.multiply(counts, idf, out=rows[len(at)], casting="unsafe")
                at.append(k)
                if len(at) == len(rows):
                    settle()
            if at:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)
