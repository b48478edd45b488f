"""A dense family whose members are mostly apart: full search without pairs leaving a cell."""

import random

import numpy as np
import pyarrow as pa
from test_near_families import components_of
from test_text_operators import brute_components

from parcelspark.llm import minhash_forest


def edited_copies(count, length, edits, seed):
    """Copies of one text, each with ``edits`` words of its own at random places."""
    draw = random.Random(seed)
    base = [f"base{k}" for k in range(length)]
    rows = []
    for n in range(count):
        words = list(base)
        for k in draw.sample(range(length), edits[n % len(edits)]):
            words[k] = f"own{n}x{k}"
        rows.append((n, " ".join(words)))
    return rows


def test_copies_around_the_threshold(spark):
    rows = edited_copies(700, 120, (2, 3, 4, 5), 7)
    assert components_of(spark, rows) == brute_components(rows, 3, 85)


def test_cell_links_equal_brute_force_and_form_a_forest():
    texts = [text for _, text in edited_copies(120, 90, (1, 2, 3), 11)]
    sets, _ = minhash_forest.shingle_sets(texts, 3)
    label = [n if n % 4 else 0 for n in range(120)]
    table = pa.table({"doc_id": range(120), "label": label, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    got = minhash_forest._joining_links(table, 85).to_pylist()
    held = [set(s.tolist()) for s in sets]
    linked = lambda a, b: 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])
    assert got and len(got) < len(set(label)) and all(linked(pair["a"], pair["b"]) for pair in got)

    def groups(pairs):
        root = dict(enumerate(label))
        for _ in range(120):
            for a, b in pairs:
                low = min(root[a], root[b])
                for end in (a, b):
                    old = root[end]
                    if old != low:
                        root = {k: low if v == old else v for k, v in root.items()}
        return root

    every = [(a, b) for a in range(120) for b in range(a) if label[a] != label[b] and linked(a, b)]
    assert groups([(p["a"], p["b"]) for p in got]) == groups(every)


def test_a_strip_boundary_splits_nothing(monkeypatch):
    monkeypatch.setattr(minhash_forest, "STRIP", 7)
    sets = [np.arange(40, dtype=np.uint64), np.arange(3, 43, dtype=np.uint64), np.arange(100, 140, dtype=np.uint64)]
    table = pa.table({"doc_id": [1, 2, 3], "label": [1, 2, 3], "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    assert minhash_forest._joining_links(table, 86).to_pylist() == [{"a": 1, "b": 2}]
    assert minhash_forest._joining_links(table, 87).to_pylist() == []
