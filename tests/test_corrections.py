"""Replay of corrections as a table against the plain loop over all of them."""

import random

import pytest
from pyspark.errors import PySparkException

from lumenark.operators import events as E
from lumenark.operators.components import joined_sets
from lumenark.plans import events as plans
from lumenark.sources.tables import captures


def plain(groups, corrections):
    """Group of each id: every step looks at all groups."""
    group_of = dict(groups)
    members = {}
    for i, g in group_of.items():
        members.setdefault(g, set()).add(i)
    for number, operation, ids, _ in sorted(corrections):
        known = [i for i in ids if i in group_of]
        if operation == "SPLIT":
            new = f"split-{number}"
            for i in known:
                members[group_of[i]].discard(i)
                members.setdefault(new, set()).add(i)
                group_of[i] = new
        elif operation == "MERGE":
            hit = {group_of[i] for i in known}
            if len(hit) > 1:
                new = f"merge-{number}"
                members[new] = set().union(*(members.pop(g) for g in hit))
                for i in members[new]:
                    group_of[i] = new
    return group_of


def test_random_corrections(spark):
    rng = random.Random(4)
    groups = {i: f"{i % 5}:{rng.randrange(1, 60)}" for i in range(1_500)}
    rows = [(i, int(g.split(":")[0]), int(g.split(":")[1])) for i, g in groups.items()]
    sessions = spark.createDataFrame(rows, "id long, user_id long, session long")
    for n in (0, 1, 40, 700):
        made = [(k * 3, rng.choice(["MERGE", "SPLIT", "MERGE", "RENAME"]), [rng.choice([rng.randrange(1_500), rng.randrange(30), 99_999]) for _ in range(rng.randrange(4))], "t") for k in range(n)]
        table = spark.createDataFrame(made, E.CORRECTION).repartition(3)
        got = {r.id: r.grp for r in E.corrected(sessions, table).collect()}
        assert got == plain(groups, made), n


def test_ten_thousand_corrections_have_one_plan(spark, sf_dir):
    sessions = E.sessionize(captures(spark, sf_dir))
    groups = {r.id: f"{r.user_id}:{r.session}" for r in sessions.collect()}
    made = plans.made_corrections(spark, sf_dir)
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) >= 10_000
    got = E.corrected(sessions, made)
    assert {r.id: r.grp for r in got.collect()} == plain(groups, rows)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert size(got) == size(E.corrected(sessions, made.limit(5)))


def test_linked_corrections_are_not_one_call(spark):
    """All corrections are linked by one id; no task of Python gets them as one group."""
    rng = random.Random(6)
    groups = {i: f"1:{i // 3}" for i in range(600)}
    sessions = spark.createDataFrame([(i, 1, i // 3) for i in groups], "id long, user_id long, session long")
    made = [(k, ["MERGE", "MERGE", "SPLIT"][k % 3], [0, *rng.sample(range(600), 4)] if k % 3 < 2 else [rng.randrange(600), 0], None) for k in range(400)]
    got = E.corrected(sessions, spark.createDataFrame(made, E.CORRECTION))
    assert {r.id: r.grp for r in got.collect()} == plain(groups, made)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString() and not hasattr(E, "replayed")


def test_sets_joined_in_order(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80), n // 2, n % 2) for n in range(70)]
    root, last = list(range(80)), [None] * 80
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b, n, _ in links:
        a, b = find(a), find(b)
        if a != b:
            root[b], last[a] = a, n
    got = {r.id: (r.component, r.last) for r in joined_sets(spark.createDataFrame([(f"{a:02}", f"{b:02}", n, p) for a, b, n, p in links], "a string, b string, number long, part int")).collect()}
    used = {x for a, b, *_ in links if a != b for x in (a, b)}
    assert {i: v[1] for i, v in got.items()} == {f"{x:02}": last[find(x)] for x in used}
    assert all((got[f"{x:02}"][0] == got[f"{y:02}"][0]) == (find(x) == find(y)) for x in used for y in used)


def test_unknown_operations_are_refused(spark):
    sessions = spark.createDataFrame([(1, 1, 1)], "id long, user_id long, session long")
    with pytest.raises(PySparkException, match="unknown correction ERASE"):
        E.corrected(sessions, [("ERASE", [1])]).collect()
