"""Held-out accuracy, and defined results."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from lumenark.llm import language
from lumenark.llm.language import fit, predict
from lumenark.llm.shared import remainder


def test_held_out_accuracy(corpus):
    held = remainder(F.col("doc_id"), 3) == 1
    model = fit(corpus.where(~held), per_language=60)
    rows = predict(corpus, model, held).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_letters_nulls_and_nothing_learned(spark, docs, corpus):
    model = fit(corpus.where("doc_id < 300"), per_language=30)
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "the and of the"), (None, "the"), (4, "the and of the"), (5, "ß" * 50_000)]
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in predict(docs(rows, extra=True), model, F.lit(False)).collect()]
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)] and got[3] == got[5] and got[3][1] == "en" and len(got) == 7
    assert fit(corpus.where("false")) is None and fit(corpus.withColumn("lang", F.lit(None).cast("string"))) is None
    assert [r.lang_pred for r in predict(docs(rows), None, F.lit(False)).collect()] == ["und"] * 7
    one = fit(corpus.where("lang = 'fr'"), per_language=5)
    assert predict(docs(rows[3:4]), one, F.lit(False)).first()[2:] == ("fr", 1.0)
    assert predict(docs([]), model, F.lit(False)).count() == 0


def test_every_language_is_learned_from_a_bounded_sample(spark, monkeypatch):
    rows = [(i, f"w{i} q{k} q{k}", f"l{k}") for k in range(60) for i in range(1 + k % 3)]
    rows += [(None, f"null {i}", "hot") for i in range(300)] + [(7, "a copy", "copies")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    monkeypatch.setattr(language, "linear_svm", lambda x, y: seen.append(len(x)) or (np.zeros(x.shape[1], np.float32), 0.0))
    assert fit(df, per_language=5).languages == sorted({r[2] for r in rows})
    n = {r.lang: r["count"] for r in language.sampled(df, 5).groupBy("lang").count().collect()}
    assert n == {f"l{k}": 1 + k % 3 for k in range(60)} | {"hot": 5, "copies": 1}
    assert max(seen) <= 10


def plain(model, text):
    """(lang, score) of one text, n-gram by n-gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    own = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    margins = [float(b) for b in model.bias]
    for j, k in enumerate(language.ORDERS):
        grams = collections.Counter(own[i : i + k] for i in range(len(own) - k + 1))
        for p in range(len(model.pairs)):
            total = 0.0
            for gram, times in grams.items():
                code = 0
                for b in gram:
                    code = (code * 257 + b) % 2**32
                slot = code * 2654435761 % 2**32 >> 32 - 11
                total += times * float(model.weights[p, j * 2048 + slot])
            margins[p] += total / max(1, sum(grams.values()))

    def winner(level, names):
        votes, sums, least = ({n: x for n in names} for x in (0, 0.0, 1.0))
        for p, (at, a, b) in enumerate(model.pairs):
            if at == level:
                m = margins[p]
                votes[a if m >= 0 else b] += 1
                sums[a], sums[b] = sums[a] + m, sums[b] - m
                share = 1 / (1 + math.exp(-max(-30, min(30, model.scale[p] * m))))
                least[a], least[b] = min(least[a], share), min(least[b], 1 - share)
        best = min(names, key=lambda n: (-votes[n], -sums[n], n))
        return best, least[best]

    group, p = winner("", sorted({language.family(x) for x in model.languages}))
    lang, q = winner(group, sorted(x for x in model.languages if language.family(x) == group))
    return lang, min(p, q)


def test_every_row_against_a_plain_predictor(spark, docs, corpus):
    model = fit(corpus.where("doc_id % 2 = 0").unionByName(spark.createDataFrame([(10**6 + i, f"dit is een zin {i} van het huis", "nl", "x", 1) for i in range(30)], corpus.schema)), per_language=60)
    assert "nl" in model.languages and {p[0] for p in model.pairs} > {""}
    rows = [(r.doc_id, r.text) for r in corpus.where("doc_id < 200").collect()] + [(-1, None), (-2, ""), (-3, "a"), (-4, "Ab"), (-5, "…é"), (-6, "中文 text"), (-7, "x" * 30_000), (-8, "12")]
    text = dict(rows)
    got = predict(docs(rows), model, F.lit(False)).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain(model, text[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5, r.doc_id


def test_the_sample_is_bounded_in_all(spark):
    rows = [(i, f"text {i}", f"l{i % 10}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in language.sampled(df, 100, in_all=300).groupBy("lang").count().collect()}
    assert n == {f"l{k}": 30 for k in range(10)}
    assert {r["count"] for r in language.sampled(df, 100, in_all=1).groupBy("lang").count().collect()} == {language.LEAST}
