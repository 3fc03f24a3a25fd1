"""Fusion of ranked variants and channels at small limits, and of what must be refused."""

import random

import pytest
from pyspark.errors import PySparkException

from lumenark.operators.captions import fused_variants
from lumenark.operators.retrieval import fuse


def test_every_variant_counts_at_any_limit(spark):
    rng = random.Random(2)
    rows = [(v, i, rng.random()) for v in range(3) for i in range(900) if rng.random() < 0.8]
    best, want = {}, {}
    for v, i, s in rows:
        best[v, i] = max(best.get((v, i), 0), round(s, 9))
    for v in range(3):
        for place, (_, i) in enumerate(sorted((-s, i) for (w, i), s in best.items() if w == v), 1):
            want[i] = want.get(i, 0) + 1 / (60 + place)
    ranked = sorted(((-round(s, 9), i) for i, s in want.items()))
    df = spark.createDataFrame(rows, "variant int, id long, score double")
    for limit in (1, 2, 40):
        assert [(r.id, r.score) for r in fused_variants(df, limit).collect()] == [(i, -s) for s, i in ranked[:limit]]


def test_an_item_low_in_one_variant_keeps_that_term(spark):
    """Two variants and a limit of one: what is far down in a variant still adds its term."""
    n = 8 * 61
    rows = [(0, i, 1.0 - i / 10_000) for i in range(n)] + [(1, 50_000 + i, 1.0 - i / 10_000) for i in range(n)]
    rows += [(0, 9001, 0.99995), (1, 9001, 0.1), (0, 9002, 0.99985)]
    got = fused_variants(spark.createDataFrame(rows, "variant int, id long, score double"), 1).first()
    assert (got.id, got.score) == (9001, round(1 / 62 + 1 / (60 + n + 1), 9))


@pytest.mark.parametrize("weights", [[("a", 1.0)], [("a", 1.0), ("b", -0.1)], [("a", 1.0), ("b", None)]])
def test_channels_need_weights(spark, weights):
    ranked = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.4)], "channel string, id long, score double")
    with pytest.raises(PySparkException, match="no weight"):
        fuse(ranked, spark.createDataFrame(weights, "channel string, weight double")).collect()
