"""Families of similar texts that are only partly near copies: components equal brute force."""

from test_text_operators import brute_components

from parcelspark.llm import minhash_forest


def components_of(spark, rows):
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_pairs_within_a_large_family(spark):
    """600 texts with a common passage, similar at 0.79 and so not linked, of which 200 are pairs at 0.863."""
    common = " ".join(f"common{k}" for k in range(62))
    rows = [(n, " ".join([common, *(f"pair{n // 2 if n < 200 else n}x{k}" for k in range(3)), *(f"own{n}x{k}" for k in range(5))])) for n in range(600)]
    want = brute_components(rows, 3, 85)
    assert len({label for _, _, label in want}) == 500
    assert components_of(spark, rows) == want


def test_clusters_joined_by_one_pair(spark):
    """40 families of two clusters of three; of the nine pairs between two clusters only one is a near copy (60 of 70 shingles)."""
    rows = []
    for family in range(40):
        common = " ".join(f"f{family}w{k}" for k in range(62))
        for n in range(6):
            own = [f"f{family}c{n // 3}x{k}" for k in range(3)] + [f"f{family}d{n}x{k}" for k in range(n % 3 + 2)]
            rows.append((family * 6 + n, " ".join([common, *own])))
    want = brute_components(rows, 3, 85)
    assert len({label for _, _, label in want}) == 40
    assert components_of(spark, rows) == want
