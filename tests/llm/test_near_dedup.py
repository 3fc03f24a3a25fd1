"""Near duplicates against all pairs, and the sketches' properties."""

import random
import re

import numpy as np
import pytest

from lumenark.llm import near_dedup
from lumenark.llm.near_dedup import band_keys, deduplicated, near_duplicates, rows_per_band, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(d for d in sets if sets[d])
    for i, a in enumerate(known):
        for b in known[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, words, copies, edits):
    """Copies of a text, each with its own edits: similarities spread around the threshold."""
    base = [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = str(rng.random())
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(docs, k, percent):
    rng = random.Random(k)
    texts = family(rng, 150, 120, 9) + family(rng, 60, 60, 4) + family(rng, 400, 30, 20)
    texts += ["", "A b", "a B", "one two three four", "ONE two three four", "x " * 300, "X " * 200, None, " \t\n", "é É"]
    texts += texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows, extra=True), words_per_shingle=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def test_kept_rows_repeats_and_null_ids(docs):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (None, "a b c d"), (7, None), (8, None)]
    got = sorted(near_duplicates(docs(rows), words_per_shingle=3, percent=85).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 1, False), (1, 1, True), (None, None, True), (7, 7, True), (8, 8, True)} and len(got) == 6
    left = deduplicated(docs(rows, extra=True), words_per_shingle=3, percent=85).collect()
    assert sorted(((r.doc_id, r.key) for r in left), key=str) == [(1, "x"), (7, "x"), (8, "x"), (None, "x")]


def test_families_and_hubs_are_dealt_in_parts(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 20)
    monkeypatch.setattr(near_dedup, "PARTNERS", 7)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 150, 150, 14) + family(rng, 90, 80, 12)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), words_per_shingle=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_repeats_cost_no_more_than_rows(docs, monkeypatch):
    """60 equal rows of one id and 60 of another are one pair to confirm."""
    seen = []
    keep = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name, result=False: seen.append((name, keep(df, name, result))) or seen[-1][1])
    monkeypatch.setattr(near_dedup, "passing", lambda spark: __import__("contextlib").nullcontext())
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base))] * 60 + [(2, " ".join([*base, "end"]))] * 60
    got = near_duplicates(docs(rows).repartition(5)).collect()
    assert len(got) == 120 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1)}
    assert {n: df.count() for n, df in seen if n in ("classes", "pairs", "confirmed", "texts")} == {"classes": 2, "pairs": 1, "confirmed": 1, "texts": 2}


def test_an_id_with_several_texts(docs):
    base, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(5, base), (5, other), (5, None), (5, ""), (7, base + " x"), (3, other + " y"), (9, None), (9, None), (None, base), (None, base), (11, "p " + base[::-1]), (11, "q " + other[::-1])]
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(docs(rows, extra=True).selectExpr("*", "1 as hash", "2 as row")).collect()}
    assert got == {(5, 5, 96), (5, 3, 96), (5, 5, 0), (7, 5, 97), (3, 3, 97), (9, 9, 0), (None, None, 96), (11, 11, 97)}
    for _ in range(2):
        df = docs(rows, extra=True).selectExpr("*", "1 as hash", "2 as row").repartition(3)
        left = deduplicated(df)
        assert left.columns == df.columns
        texts = sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str)
        assert texts == sorted([(5, base), (5, ""), (3, other + " y"), (9, ""), (None, base), (None, base), (11, "p " + base[::-1]), (11, "q " + other[::-1])], key=str)
    assert near_duplicates(docs([(1, "word " * 50_000 + "end"), (2, "word " * 70_000 + "end")])).where("component_id = 1").count() == 2


def test_the_chance_to_miss_a_pair():
    for percent, rows, bands in ((85, 5, 24), (80, 4, 30)):
        assert rows_per_band(percent) == rows and near_dedup.BINS // rows == bands and (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0 and deduplicated(docs([], extra=True)).count() == 0


def test_every_coordinate_is_filled_and_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 200):
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        s = sketches([own])
        assert (s > 0).all()
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    pairs = [(base[:300], base[60:360])] * 1  # similarity 240 / 360
    a, b = sketches([np.unique(pairs[0][0]), np.unique(pairs[0][1])], bins=2048)
    assert abs((a == b).mean() - 2 / 3) < 0.06
    assert (band_keys(sketches([base, base]), 5)[0] == band_keys(sketches([base]), 5)[0]).all()


def test_the_row_that_stays_does_not_depend_on_the_plan(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, f"lang{i}") for i in range(50)] + [(2, text, "z"), (3, "other words here now too", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [sorted(tuple(r) for r in deduplicated(df.repartition(n)).collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == [1, 3]
