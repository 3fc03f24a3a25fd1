"""Patches of all sessions against a walk through each."""

import random

import pytest
from pyspark.errors import PySparkException

from lumenark.operators.patches import active_plans, chained

PATCH = "session_id long, set_id long, parent_id long, created_ms long, operations array<struct<type: string, field: string, value: string>>"


def walk(rows):
    plans, depth = {}, {}
    for session in {r[0] for r in rows}:
        latest, n = None, 0
        for _, s, parent, _, operations in sorted((r for r in rows if r[0] == session), key=lambda r: (r[3], r[1])):
            if parent != latest:
                continue
            latest, depth[session, s] = s, n
            n += 1
            for kind, field, value in operations:
                if kind == "REMOVE":
                    plans.pop((session, field), None)
                else:
                    plans[session, field] = (value, s)
    return plans, depth


def test_all_sessions_like_a_walk(spark):
    rng = random.Random(4)
    rows = []
    for session in range(60):
        for s in range(rng.choice([1, 2, 5, 30])):
            fields = rng.sample(["TIME", "PLACE", "SORT", "OCR"], rng.randrange(1, 4))
            parent = None if s == 0 or rng.random() < 0.05 else s - 1 if rng.random() < 0.7 else rng.randrange(s)
            rows.append((session, s, parent, s * 10, [(rng.choice(["ADD", "REPLACE", "REMOVE"]), f, f"v{s}") for f in fields]))
    rows += [(99, s, s - 1 if s else None, s, [("ADD", "LIMIT", str(s))]) for s in range(1_500)]  # a long chain
    plans, depth = walk(rows)
    df = spark.createDataFrame(rows, PATCH).repartition(3)
    assert {(r.session_id, r.set_id): r.depth for r in chained(df).where("depth is not null").collect()} == depth
    assert {(r.session_id, r.field): (r.value, r.set_id) for r in active_plans(df).collect()} == plans
    assert plans[99, "LIMIT"] == ("1499", 1499)


@pytest.mark.parametrize("operations", [[], [("ADD", "TIME", "a"), ("REMOVE", "TIME", "b")], [("DROP", "TIME", "a")], [("ADD", "PATH", "a")]])
def test_unsound_patches_are_refused(spark, operations):
    with pytest.raises(PySparkException, match="patch"):
        active_plans(spark.createDataFrame([(1, 1, None, 1, operations)], PATCH)).collect()


def test_empty(spark):
    assert active_plans(spark.createDataFrame([], PATCH)).count() == 0
