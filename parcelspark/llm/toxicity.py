"""Toxicity: logistic regression on words with a counterfactual penalty.

The labelled sample is extended by counterfactual copies in which every identity term, matched as a whole word,
is swapped for each other of its group, and by copies into which a term is put. The fit adds to the log loss the squared
change of the score between a text and its copy, so that naming a group does not
move the score, and an L1 penalty that leaves few words with a weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from parcelspark.llm.textblocks import slices, words_of

BITS = 18
#: Labelled rows that the classifier is fitted to, at most about; a bound of the method.
SAMPLE_ROWS = 6000
#: Copies of labelled sentences into which each known identity term is put.
INSERTIONS = 200
#: Identity terms of four languages by group; a term is swapped for the others of its group.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["female", "male"], ["she", "he"], ["her", "his"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"],
    ["africans", "europeans", "asians", "americans"], ["african", "european", "american"], ["mexican", "chinese", "indian", "german", "french"],
    ["immigrants", "natives"], ["immigrant", "native"], ["disabled", "deaf", "blind"], ["elderly", "young", "old"],
    ["frauen", "männer"], ["frau", "mann"], ["mädchen", "jungen"], ["muslime", "christen", "juden", "hindus"], ["türken", "polen", "deutsche", "franzosen"], ["einwanderer", "einheimische"],
    ["femmes", "hommes"], ["femme", "homme"], ["filles", "garçons"], ["musulmans", "chrétiens", "juifs", "hindous"], ["africains", "européens", "asiatiques"], ["immigrés", "autochtones"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["chicas", "chicos"], ["musulmanes", "cristianos", "judíos", "hindúes"], ["africanos", "europeos", "asiáticos"], ["inmigrantes", "nativos"],
]
GROUP_OF = {term: group for group in IDENTITY for term in group}
MARKS = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


#: Place of each identity term, beyond the hashed ones.
TERM_PLACE = {term: (1 << BITS) + k for k, term in enumerate(GROUP_OF)}
#: Lengths, in characters, of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)


def features(word: bytes) -> tuple[int, ...]:
    """Hashed places of a word without the marks around it, and of its beginnings; none if nothing is left.

    A whole identity term has one place of its own beyond the hashed ones and no beginnings, so no other word shares its weight.
    """
    word = word.strip(MARKS)
    if not word:
        return ()
    text = word.decode("utf-8", "replace")
    if text in TERM_PLACE:
        return (TERM_PLACE[text],)
    parts = [word, *(b"^" + text[:n].encode() for n in PREFIXES if len(text) > n)]
    return tuple(zlib.crc32(part) & (1 << BITS) - 1 for part in parts)


def features_of(text: str | None) -> set[int]:
    """Distinct features of a text."""
    return {f for word in set(words_of(text)) for f in features(word)}


@dataclass
class ToxicityModel:
    places: np.ndarray  # features with a weight
    weights: np.ndarray
    bias: float


def _swaps() -> dict[int, list[int]]:
    """Place of every identity term, with those of the others of its group, beginning with the next."""
    out = {}
    for term, group in GROUP_OF.items():
        at = group.index(term)
        out[TERM_PLACE[term]] = [TERM_PLACE[other] for other in group[at + 1 :] + group[:at]]
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, l1: float = 4e-4, least: float = 0.25) -> ToxicityModel:
    """Selection by a strong L1 penalty, then weights of the selected features under a weak one."""
    first = _fit(rows, labels, l1)
    strong = first.places[np.abs(first.weights) >= least]
    return _fit([np.intersect1d(row, strong, assume_unique=True) for row in rows], labels, l1 / 20) if len(strong) else first


def _fit(rows: list[np.ndarray], labels: np.ndarray, l1: float, fairness: float = 1.0, steps: int = 400, least_docs: int = 3) -> ToxicityModel:
    """Fit to rows of distinct features by accelerated proximal gradient.

    No rows, or rows of one label, give a constant score near the share of label 1.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    empty = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return empty
    used, counts = np.unique(np.concatenate(rows), return_counts=True)
    used = used[counts >= least_docs]
    if not len(used):
        return empty
    columns, owners = [], []
    swap, pairs = _swaps(), []
    for k, row in enumerate(rows):
        columns.append(np.intersect1d(row, used, assume_unique=True))
        owners.append(np.full(len(columns[-1]), k))
        changed = [f for f in row.tolist() if f in swap]
        if changed:
            pairs.append((k, changed))
    place = np.searchsorted(used, np.concatenate(columns))
    owner = np.concatenate(owners)
    # differences between texts and counterfactual copies: +1 on the term, -1 on its stand-in
    number = {f: i for i, f in enumerate(used.tolist())}
    d_owner, d_place, d_sign = [], [], []
    copies = 0
    for _, changed in pairs:
        for k in range(max(len(swap[f]) for f in changed)):
            for f in changed:
                for g, sign in ((f, 1.0), (swap[f][k % len(swap[f])], -1.0)):
                    if g in number:
                        d_owner.append(copies)
                        d_place.append(number[g])
                        d_sign.append(sign)
            copies += 1
    # INSERTIONS copies that differ by the term alone have the gradient of one of this size
    for f in swap:
        if f in number:
            d_owner.append(copies)
            d_place.append(number[f])
            d_sign.append(INSERTIONS**0.5)
            copies += 1
    d_owner, d_place, d_sign = np.array(d_owner, np.int64), np.array(d_place, np.int64), np.array(d_sign, np.float64)
    m, size = len(rows), len(used)
    w, b, v, vb, t = np.zeros(size), empty.bias, np.zeros(size), empty.bias, 1.0
    per_row = np.bincount(owner, minlength=m)
    # an upper bound of the curvature: rows x columns sums of the bipartite graph
    bound = 0.25 * float(np.bincount(place, weights=per_row[owner] + 1.0, minlength=size).max()) / m + 0.25
    if copies:
        length = np.bincount(d_owner, weights=np.abs(d_sign))
        bound += 2 * fairness * float(np.bincount(d_place, weights=np.abs(d_sign) * length[d_owner], minlength=size).max()) / m
    step = 1 / bound
    for _ in range(steps):
        margin = np.bincount(owner, weights=v[place], minlength=m) + vb
        error = (1 / (1 + np.exp(-margin)) - labels) / m
        grad = np.bincount(place, weights=error[owner], minlength=size)
        if copies:
            change = np.bincount(d_owner, weights=v[d_place] * d_sign, minlength=copies)
            grad += 2 * fairness / m * np.bincount(d_place, weights=change[d_owner] * d_sign, minlength=size)
        moved = v - step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = vb - step * error.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    kept = np.flatnonzero(w)
    return ToxicityModel(used[kept], w[kept], float(b))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model from labelled documents; rows with a null text or label, or a label other than 0 and 1, are left out.

    The rows used are those whose id hash falls in the share that makes about ``sample_rows``.
    An id that is labelled more than once gives a row for each label.
    """
    marks = (labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("label")).filter("label in (0, 1)")
             .withColumn("place", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))))
    share = min(1.0, sample_rows / max(marks.count(), 1))
    chosen = marks.filter(F.col("place") <= int(share * (1 << 30)))  # bounded by sample_rows
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).dropna(subset=["id", "text"])
    rows = texts.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) <= int(share * (1 << 30))).join(chosen, "id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [np.array(sorted(features_of(t)), np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(found, pa.binary())], names=["place", "label", "words"])

    sample = rows.select("place", "label", "text").mapInArrow(words, "place long, label int, words binary").collect()
    sample.sort(key=lambda row: (row.place, row.label, row.words))
    return fit([np.frombuffer(row.words, np.int32).astype(np.int64) for row in sample], np.array([row.label for row in sample], np.int64))


class WordWeights(dict):
    """Indices of a word's features among the weighted ones; filled as words come."""

    def __init__(self, places: np.ndarray):
        super().__init__()
        self.number = {p: k for k, p in enumerate(places.tolist())}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = tuple(self.number[f] for f in features(word) if f in self.number)
        return found


def score(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """The input's columns with ``score`` (0 to 1, higher: more toxic) and ``predicted`` (1 from 0.5 on).

    A null or empty text has the score of a text without weighted words. Input columns of these
    two names are replaced. Rows stay as they are.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights, and one per identity term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, weights = WordWeights(model.places), model.weights.tolist()
        for batch in slices(batches, text_column):
            margins = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(text_column).to_pylist()):
                found = {f for some in filter(None, map(table.__getitem__, set(words_of(text)))) for f in some}
                margins[k] = model.bias + sum(sorted(weights[f] for f in found))
            scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)
