import random

from parcelspark.operators.ranking import rank_auc


def test_auc_equals_all_pairs_with_ties(spark):
    r = random.Random(3)
    rows = [(g, r.randrange(2), float(r.randrange(12))) for g in ("a", "b") for _ in range(300)] + [("one", 1, 2.0), ("one", 1, 3.0), ("a", None, 1.0), ("a", 1, None)]
    got = {x.g: x for x in rank_auc(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    for g in ("a", "b"):
        own = [(l, s) for h, l, s in rows if h == g and l is not None and s is not None]
        pairs = [1.0 if p > q else 0.5 if p == q else 0.0 for a, p in own if a for b, q in own if not b]
        assert abs(got[g].auc - sum(pairs) / len(pairs)) < 1e-12 and got[g].n == len(own) and got[g].n_positive == sum(l for l, _ in own)
    assert got["one"].auc is None
    assert rank_auc(spark.createDataFrame([], "g string, label int, score double"), ["g"]).count() == 0
