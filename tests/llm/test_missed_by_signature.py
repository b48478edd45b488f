"""Pairs just at the threshold whose signatures agree too little, or share no first values in any tree."""

import numpy as np
from test_near_families import components_of
from test_text_operators import brute_components

from parcelspark.llm import minhash_forest

#: Found by trying 8,000 seeds: signatures below the threshold less three standard errors, and no common first six values.
LOW, APART = [793, 992, 1198, 1347, 2832, 3364], [2783, 3055, 3919, 5798]


def pair_of(seed):
    """Two texts with 85 common shingles of 100."""
    common = " ".join(f"s{seed}w{k}" for k in range(87))
    return [common + " " + " ".join(f"s{seed}{side}{k}" for k in range(n)) for side, n in (("a", 8), ("b", 7))]


def test_pairs_that_signatures_miss(spark):
    rows = list(enumerate(text for seed in LOW + APART for text in pair_of(seed)))
    want = brute_components(rows, 3, 85)
    assert len({label for _, _, label in want}) == len(LOW + APART)
    assert components_of(spark, rows) == want


def test_one_family_of_missed_pairs(spark):
    """A common stretch that most of 700 texts hold, and missed pairs among them."""
    shared = " ".join(f"licence{k}" for k in range(20))
    others = [f"{shared} " + " ".join(f"o{n}w{k}" for k in range(30)) for n in range(680)]
    rows = list(enumerate([text for seed in LOW + APART for text in pair_of(seed)] + others + [shared, shared]))
    assert components_of(spark, rows) == brute_components(rows, 3, 85)


def test_lanes_meet_every_pair_once(spark, monkeypatch):
    """Small lanes give the same pairs as a plain loop over the places of shared shingles."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 3)
    monkeypatch.setattr(minhash_forest, "WIDE", 4)
    draw = np.random.default_rng(5)
    held = [(shingle, doc, int(doc % 7 if doc % 3 else 0), 100, int(draw.integers(84, 101))) for shingle in range(4) for doc in range(20)]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in held for b in held
            if a[0] == b[0] and a[2] != b[2] and 185 * min(a[4], b[4]) >= 85 * 200}
    spots = spark.createDataFrame(held, "shingle long, doc_id long, label long, n long, room long")
    got = [(r.a, r.b) for r in minhash_forest.prefix_pairs(spots, 85).collect()]
    assert len(got) == len(set(got)) and set(got) == want
