"""Mixing against plain Python; targets, epochs, ties and odd rows."""

import hashlib
import math
import random
import re

import pytest

from lumenark.llm import mixing
from lumenark.llm.mixing import mixed, mixture

WORD = re.compile("[^\x20\x09-\x0d]+")


def shares(sizes, weights, percent, epochs):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    budget, open_, out = percent * sum(sizes.values()) / 100, set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > epochs * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(epochs * sizes[s])
            budget -= out[s]
            open_.remove(s)
    return out


def plain(rows, quality, weights=(3, 1, 2), percent=150, epochs=2):
    marks = {}
    for i, q in quality:
        if i is not None and q is not None:
            marks.setdefault(i, []).append(q)
    docs, sizes = [], {}
    for doc_id, source, text in rows:
        size = len(WORD.findall(text or ""))
        identity = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
        q = sum(marks[doc_id]) / len(marks[doc_id]) if doc_id in marks else 0.5
        u = (int(hashlib.md5(f"2024:{identity}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        docs.append((source, -math.log(u) / (1 + 3 * q), doc_id is None, doc_id or 0, size, doc_id))
        sizes[source] = sizes.get(source, 0) + size
    target, before, out = shares(sizes, weights, percent, epochs), {}, []
    for source, _, _, _, size, doc_id in sorted(docs, key=lambda d: d[1:5]):
        whole = math.floor(target[source] / sizes[source]) if sizes[source] else 0
        b = before.get(source, 0)
        before[source] = b + size
        copies = whole + (size > 0 and 2 * b + size <= 2 * (target[source] - whole * sizes[source]))
        out.append((doc_id, size, sizes[source], round(target[source], 6), copies * size))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def corpus_rows(rng):
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "Z", "é", "\U0001f600", "", None]), " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 7, 60])))) for i in range(400)]
    return rows + [(400, "a", None), (401, "a", ""), (402, "one", "x y " * 20_000), (403, "blank", " \t\n"), (None, "a", "p q"), (None, "hot", "p q r"), (3, "hot", "again"), (3, "hot", "again and again"), *rows[:4]]


@pytest.mark.parametrize("few", [0, 50_000])
def test_like_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rng = random.Random(11)
    rows = corpus_rows(rng)
    quality = [(i, rng.choice([0.0, 1.0, None])) for i in range(0, 400, 3)] + [(3, 1.0), (6, 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as before", "'x' as weight", "2 as target", "9 as size", "8 as sample_key", "7 as row").repartition(5)
    marks = spark.createDataFrame(quality, "doc_id long, quality double")
    got = mixture(df, marks)
    assert rows_of(got) == plain(rows, quality)
    assert rows_of(mixture(df, None, (1, 5), 40, 1)) == plain(rows, [], (1, 5), 40, 1)
    assert rows_of(mixture(df, None, (1,), 900, 2)) == plain(rows, [], (1,), 900, 2)  # more than there is: everything twice
    taken = {}
    for r in got.collect():
        t = taken.setdefault(r.source, [0, r.target, 0])
        t[0], t[2] = t[0] + r.taken, max(t[2], r["size"])
        assert r.taken <= 2 * r["size"]
    assert all(abs(a - b) <= c / 2 for a, b, c in taken.values())
    mix = mixed(df, marks)
    assert mix.columns == df.columns
    want = {}
    for r in got.collect():
        if r.taken:
            want[r.doc_id, r["size"]] = want.get((r.doc_id, r["size"]), 0) + r.copies
    have = {}
    for r in mix.collect():
        key = r.doc_id, len(WORD.findall(r.text))
        have[key] = have.get(key, 0) + 1
    assert {k: v for k, v in have.items() if k[0] is not None and k[0] > 3} == {k: v for k, v in want.items() if k[0] is not None and k[0] > 3}


def test_better_documents_are_likelier(spark):
    rows = [(i, "s", "a b c d") for i in range(4_000)]
    marks = spark.createDataFrame([(i, float(i % 2)) for i in range(4_000)], "doc_id long, quality double")
    got = mixture(spark.createDataFrame(rows, "doc_id long, source string, text string"), marks, share_percent=25).where("taken > 0").collect()
    good = sum(r.doc_id % 2 for r in got)
    assert len(got) == 1_000 and 720 < good < 860  # drawn without replacement at 4 to 1


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixture(none).count() == 0 and mixed(none).count() == 0
    null = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    assert rows_of(mixture(null)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
