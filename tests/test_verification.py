"""Tolerance join, people references and balanced objects against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from lumenark.functions.objects import first_balanced, first_object
from lumenark.operators import people_references as P
from lumenark.operators.verification import TOLERANCE, asked_cells, within_tolerance

BOX = "id long, k int, left double, top double, right double, bottom double"


def test_boxes_near_each_other_are_those_of_all_pairs(spark):
    rng = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            x, y = (rng.choice([0.0, 0.02, 0.04, 0.3, rng.random()]) for _ in range(2))
            jitter = lambda: rng.choice([0, 0.005, 0.0199, 0.0201, -0.01])
            out.append((i, rng.randrange(2), x + jitter(), y + jitter(), x + 0.1, rng.choice([None, y + 0.1, y + 0.1, y + 0.1])))
        return out

    a, b = some(150), some(400)
    got = {(r.id, r.known_id) for r in within_tolerance(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["k"]).collect()}
    near = lambda x, y: all(p is not None and q is not None and abs(p - q) <= TOLERANCE for p, q in zip(x[2:], y[2:], strict=True))
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and near(x, y)}
    assert got == want and len(want) > 300


def test_a_box_asks_few_cells(spark):
    rng = random.Random(7)
    a = [(i, 0, x := rng.uniform(-3, 3), y := rng.uniform(-3, 3), x + 0.1, y + 0.1) for i in range(2_000)]
    b = [(i, k, x + rng.choice([-0.02, 0.0, 0.0199, 0.03]), y + rng.choice([0.02, -0.0199, -0.03]), x2, y2) for i, k, x, y, x2, y2 in a]
    wanted, known = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    near = lambda x, y: all(abs(p - q) <= TOLERANCE for p, q in zip(x[2:], y[2:], strict=True))
    got = within_tolerance(wanted, known, ["k"])
    assert {r.id for r in got.where("id = known_id").collect()} == {x[0] for x, y in zip(a, b, strict=True) if near(x, y)}
    assert asked_cells(wanted).count() < 2.6 * len(a)  # it was nine for each


def clauses(text, names):
    words = re.findall(r"\w+", text.lower())
    out = set()
    for n in range(1, 4):
        for i in range(len(words) - n + 1):
            run = " ".join(words[i : i + n])
            if run not in names or run in P.FIRST_PERSON and any(w in P.CAPTURE_VERBS for w in words[i + n : i + n + 4]):
                continue
            if run == "me" and i and words[i - 1] in P.REQUEST_VERBS and (words[i + n : i + n + 1] or [""])[0] not in P.CONTINUATIONS:
                continue
            present = not any(w in P.NEGATIONS for w in words[max(0, i - 3) : i]) and not any(w in P.TRAILING_NEGATIONS for w in words[i + n : i + n + 3])
            out |= {(person, present) for person in names[run]}
    return out


def test_references_like_a_plain_matcher(spark):
    rng = random.Random(8)
    vocabulary = ["me", "I", "main", "wife", "Anna", "Anna Maria", "Lee", "show", "took", "not", "without", "bina", "wearing", "and", "hat", "x", "y", "myself"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))) for i in range(600)] + [(600, None), (601, " , "), (602, "ＭＥ and wife"), (603, "wife " * 5_000)]
    known = [("Anna", "p1"), ("anna maria", "p2"), ("Anna  Maria Lee", "p3"), ("Lee", "p4"), ("lee", "p5"), ("", "none"), (None, "none")]
    table = P.well_known(spark).unionByName(spark.createDataFrame(known, "name string, person_id string"))
    names = {}
    for name, person in [(r.name, r.person_id) for r in table.collect()]:
        if name:
            names.setdefault(" ".join(re.findall(r"[^\W_]+|[ऀ-ॿ]+", name.lower())), set()).add(person)
    got = {}
    for r in P.person_clauses(spark.createDataFrame(rows, "id long, text string"), table).collect():
        got.setdefault(r.id, set()).add((r.person_id, r.present))
    for i, text in rows:
        want = clauses((text or "").replace("ＭＥ", "me"), names)
        assert got.get(i, set()) == want, text


def test_references_are_joined_as_runs_with_one_flag(spark):
    names = spark.createDataFrame([("Anna Maria", "p1")], "name string, person_id string")
    out = P.person_clauses(spark.createDataFrame([(1, "not Anna Maria, " + "with x " * 20_000 + "Anna Maria")], "id long, text string"), names)
    assert sorted(out.collect()) == [(1, "p1", False), (1, "p1", True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "before" not in plan and "behind" not in plan  # a slice copies all words, and its words were shuffled


def test_runs_of_few_questions_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, f"not Anna Maria, wife {i}") for i in range(50)], "id long, text string").write.parquet(f"{tmp_path}/questions")
    names = P.well_known(spark).unionByName(spark.createDataFrame([("Anna Maria", "p1")], "name string, person_id string"))
    out = P.person_clauses(spark.read.parquet(f"{tmp_path}/questions"), names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # it was built from all runs, on the driver
    assert sorted(out.where("id = 7").collect()) == [(7, "p1", False), (7, "wife", False)]


def test_references_in_a_long_text_of_different_words(spark):
    text = " ".join(f"a{i} wife" if i % 5_000 == 0 else f"a{i}" for i in range(20_000)) + " not wife"
    names = spark.createDataFrame([("wife", "wife"), ("a19998  A19999", "p1"), ("a19999 not wife", "p2"), ("a4 a6", "p3")], "name string, person_id string")
    out = P.person_clauses(spark.createDataFrame([(1, text)], "id long, text string"), names)
    assert sorted(out.collect()) == [(1, "p1", True), (1, "p2", True), (1, "wife", False), (1, "wife", True)]


def plain_object(raw):
    start, depth, inside, escaped = -1, 0, False, False
    for i, c in enumerate(raw or ""):
        if inside:
            escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
            continue
        if c == '"':
            inside = start >= 0
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return raw[start : i + 1]
    return None


def test_first_object_like_a_plain_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices('{}"\\ a\n', weights=[3, 3, 3, 1, 2, 2, 1], k=rng.randrange(0, 40))) for _ in range(3_000)]
    texts += [None, "", "{", '{"a": "}', "say " + json.dumps({"a": "b}{\\", "c": {"d": ["{"]}}) + " }", '{"' + "x" * 1_000_000 + '"}', "{" * 100_000, '{"\\']
    assert [first_balanced(t) for t in texts] == [plain_object(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", first_object(F.col("t")).alias("o"))
    assert [r.o for r in df.orderBy("id").collect()] == [plain_object(t) for t in texts]
