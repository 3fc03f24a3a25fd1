"""Importance resampling against plain Python; odd rows; the drawn documents themselves."""

import hashlib
import math
import random
import re
import zlib

import pytest

from lumenark.llm import resampling
from lumenark.llm.resampling import drawn, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, max_n):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, max_n):
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    out = []
    for doc_id, text in docs:
        own = grams(text, max_n)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def some(rng, n):
    vocabulary = ["alpha", "Beta", "GAMMA", "délta", "漢字", "x1", "5", "is", "of", "É"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00", "--", "   "]) for _ in range(n))


@pytest.mark.parametrize("max_n, buckets", [(1, 10_000), (3, 97)])
def test_like_plain_python(spark, docs, monkeypatch, max_n, buckets):
    monkeypatch.setattr(resampling, "_BLOCK", 500)
    rng = random.Random(7)
    rows = [(i, some(rng, rng.choice([0, 3, 19, 20, 40]))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, some(rng, 30_000)), (None, some(rng, 30)), (None, some(rng, 50)), (5, some(rng, 25)), (5, some(rng, 25)), *rows[:3]]
    target = [some(rng, 60).replace("alpha", "omega"), None, "", "Solo"]
    got = resampled(docs(rows, extra=True), spark.createDataFrame([(t,) for t in target], "text string"), max_n, buckets)
    assert rows_of(got) == plain(rows, target, max_n, buckets)


def test_whole_table(spark, sf_dir, corpus):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    got = rows_of(resampled(corpus, target))
    assert got == plain(rows, [r.text for r in target.collect()])
    wide = corpus.selectExpr("*", "1 as score", "2 as weight", "3 as n_words", "4 as row")
    kept = drawn(wide, target)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[4] is not None)
    assert kept.columns == wide.columns and kept.select("score", "row").distinct().collect() == [(1, 4)]


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "text string")
    assert resampled(docs([]), nothing).count() == 0 and drawn(docs([]), nothing).count() == 0
    rows = [(i, "one two three " * 10) for i in range(20)]
    assert rows_of(resampled(docs(rows), nothing)) == plain(rows, [])
    assert drawn(docs([(1, "few words")]), nothing).count() == 0
