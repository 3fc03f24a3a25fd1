"""Both ways of matching against a dictionary of all windows, and the guarantee of the fingerprints."""

import hashlib
import random
import re

import numpy as np

from lumenark.llm.decontaminate import K, W, contamination, decontaminated, fingerprint_mask, winnowed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    known = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                known.setdefault(tuple(w[k : k + n]), set()).update({i} - {None})
    lengths, out = {len(k) for k in known}, []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := known.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= own
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit)))
    return out


def test_against_all_windows(spark, docs, corpus, sf_dir):
    rng = random.Random(1)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "the and"), (901, "of THE was"), (902, ""), (903, None), (None, "a b c d e f g h i j k"), (904, "x1-y2"), (905, items[0][1]), (906, "q " * 30)]
    rows = [(r.doc_id, r.text) for r in corpus.where("doc_id < 300").collect()]
    vocabulary = [words(t) for _, t in items[:5]]
    for i in range(200):
        w = []
        for _ in range(3):
            item = rng.choice(vocabulary)
            a = rng.randrange(len(item))
            w += item[a : a + rng.randint(1, 14)] + ["filler"] * rng.randint(0, 2)
        rows.append((1000 + i, rng.choice([" ", ", ", "\n--"]).join(w).upper()))
    rows += [(2000, None), (2001, ""), (2002, "q " * 9), (2003, "q " * 5000), rows[0], (None, items[0][1])]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(rows, items), key=key)
    df, bench = docs(rows, extra=True), spark.createDataFrame(items, ITEMS)
    for bound in (10**6, 0):
        assert sorted(map(tuple, contamination(df, bench, bound).collect()), key=key) == want
        left = decontaminated(df, bench, bound)
        assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)


def test_rows_left_do_not_depend_on_the_size_of_the_test_set(spark, docs):
    """Null and repeated ids, clashing names, a null item id and a window that many items have, both ways of matching."""
    passage = " ".join(f"w{i}" for i in range(12))
    items = [(None, passage), (1, "a b"), *((100 + i, "the same ten words are in every one of these items") for i in range(50))]
    rows = [(None, f"x {passage} y"), (None, "clean"), (5, passage), (5, "clean too"), (6, "clean"), (6, "clean"), (7, "a, B!"), (8, None), (9, items[-1][1]), (10, f"{items[-1][1]} {passage}" + " filler" * 100_000)]
    df = docs(rows, extra=True).selectExpr("*", "2 as hit_id", "'r' as row", "3 as kept", "4 as window", "'f' as fingerprint")
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as length", "2 as row")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(rows, items), key=key)
    for bound in (10**6, 0):
        assert sorted(map(tuple, contamination(df, bench, bound).collect()), key=key) == want
        left = decontaminated(df, bench, bound)
        assert left.columns == df.columns and left.dtypes == df.dtypes
        assert sorted(((r.doc_id, r.text, r.hit_id, r.row) for r in left.collect()), key=str) == [(5, "clean too", 2, "r"), (6, "clean", 2, "r"), (6, "clean", 2, "r"), (8, None, 2, "r"), (None, "clean", 2, "r")]
        assert decontaminated(docs([]), bench, bound).count() == 0


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    for bound in (10, -1):
        r = contamination(docs([(1, "a b")]), none, bound).first()
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
    assert contamination(docs([]), none).count() == 0


def test_each_long_span_keeps_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(300):
        grams = rng.integers(0, 6, 40).astype(np.uint64)  # many ties
        kept = fingerprint_mask(grams, W)
        for a in range(len(grams) - W + 1):
            assert kept[a + int(winnowed(grams[a : a + W], W)[0])]
    assert K + W - 1 == 10
