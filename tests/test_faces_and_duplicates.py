"""Face search in blocks against all pairs, and duplicates among very many equal hashes."""

import random

import numpy as np
import pytest

from lumenark.operators.duplicates import collapse, duplicate_links
from lumenark.operators.identity import nearest_faces, similarities

ITEM = "id long, kind string, text string, phash long, captured_ms long"


@pytest.mark.parametrize("round_bytes", [64 << 20, 700])
def test_nearest_faces_are_those_of_all_pairs(spark, round_bytes):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[50:60] = vectors[0]  # ties
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(vectors)] + [(1000, 1, None), (1001, 1, [1.0])]
    faces = spark.createDataFrame(rows, "face_id long, cluster_id long, vector array<double>").repartition(5)
    asked = faces.where("face_id % 9 = 0").selectExpr("face_id as query_id", "vector")
    got = {}
    for r in nearest_faces(asked, faces, 5, round_bytes=round_bytes).collect():
        assert r.cluster_id == r.face_id % 7
        got.setdefault(r.query_id, []).append((-r.score, r.face_id))
    scores = np.round(vectors @ vectors.T, 6)
    want = {q: sorted((-scores[q, i], i) for i in range(300) if i != q)[:5] for q in range(0, 300, 9)}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert nearest_faces(asked.limit(0), faces).count() == 0
    with pytest.raises(ValueError, match="more than"):
        similarities(faces.selectExpr("face_id as query_id", "vector"), faces)


def test_collapse_is_that_of_all_links(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(700):
        h = rng.choice(base)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(63)
        rows.append((i, rng.choice(["IMAGE", "VIDEO"]), rng.choice(["a b", " A  B", "c", ""]), rng.choice([h, h, base[0], None]), rng.choice([None, rng.randrange(0, 400_000)])))
    rows.append((900, "IMAGE", None, 5, 5))
    items = spark.createDataFrame(rows, ITEM)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in duplicate_links(items).collect():
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in collapse(items).collect()}
    assert got == {i: root(i) for i in parent}


def test_many_equal_hashes_in_one_slot(spark):
    items = spark.range(100_000).selectExpr("id", "'IMAGE' as kind", "'same text' as text", "cast(if(id % 1000 = 7, 1, 0) as long) as phash", "id % 9000 as captured_ms")
    assert collapse(items).where("component <> 0").count() == 0
