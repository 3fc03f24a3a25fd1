"""Counts of the rules against Python, the verdicts on labelled documents, and the compression score."""

import collections
import math
import random
import re

import zstandard

from pyspark.sql import functions as F

from lumenark.llm import quality_model, quality_rules
from lumenark.llm.quality_model import fit, score
from lumenark.llm.quality_rules import clean_documents, quality_report
from lumenark.llm.shared import remainder

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit)


def test_counts(docs, corpus):
    rng = random.Random(2)
    pieces = ["a", "b", "é", "#", "\n", "\r", " ", "\t", "\x0b", "a b c", "|", "中文", "\n\n", "😀", "\x85"]
    texts = [None, "", "\n \n", "x"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a b " * 20_000]
    rows = list(enumerate(texts)) + [(5000 + r.doc_id, r.text) for r in corpus.where("doc_id < 250").collect()] + [(None, "a a a a"), (3, "x")]
    text = dict(rows)
    got = quality_report(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert quality_report(docs([])).count() == 0


def verdict(text, max_lost=0.5):
    """(kept, lost characters) by the rules, line by line."""
    n_words, word_chars, _, _, n_repeat = counts(text)
    seen, lost = set(), 0
    for line in (text or "").split("\n"):
        words = re.findall(WORD, line)
        if not words:
            continue
        chars, n = sum(map(len, words)), len(words)
        letters = sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in line)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        failed = [
            10 * len(re.findall(r"[#*$%&|<>]", line)) > chars,
            letters >= 12 and 10 * len(re.findall("[A-Z]", line)) > 6 * letters,
            n >= 4 and 4 * line.count("!") > n,
            4 * (line.count("|") + line.count("»")) > n,
            n < 4 and words[-1][-1] not in ".!?:;\"')]" + quality_rules.ENDS,
            n >= 8 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > n,
            n <= quality_rules.PHRASE_WORDS and any(p.decode() in low for p in quality_rules.BOILERPLATE),
            line in seen,
        ]
        seen.add(line)
        lost += chars * any(failed)
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    return not base_failed and lost <= max_lost * word_chars, lost


def test_verdict_of_every_row_against_plain_rules(docs, corpus):
    rng = random.Random(8)
    words = ["the", "tree", "ÉTÉ", "SHOUT", "yes!", "|", "»", "a»", "л", "end.", "fin…", "好。", "你好", "x€", "#", "&&", "Read", "more", "Mentions", "légales", "ok", "ok", "n’", "n”", "café", "ệ"]
    texts = []
    for _ in range(1200):
        lines = [rng.choice([" ", " ", "\t"]).join((f"{w}{rng.randrange(99)}" if rng.random() < 0.5 and w.isalpha() else w) for w in rng.choices(words if rng.random() < 0.5 else words[:3] + words[-4:], k=rng.randint(0, 14))) for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(lines + rng.choices(lines, k=rng.randint(0, 2))))
    rows = list(enumerate(texts)) + [(5000 + r.doc_id, r.text) for r in corpus.where("doc_id < 600").collect()] + [(-1, None), (-2, ""), (-3, "\n\r\n")]
    text, kept = dict(rows), 0
    for r in quality_report(docs(rows)).collect():
        assert (r.kept, r.lost_chars) == verdict(text[r.doc_id]), text[r.doc_id]
        kept += r.kept
    assert 200 < kept < len(rows) - 200
    assert {r.doc_id for r in clean_documents(docs(rows)).collect()} == {i for i, t in rows if verdict(t)[0]}


def test_a_text_of_one_line_may_mention_a_phrase(docs):
    prose = " ".join(f"Word{i} tells{i} about JavaScript use{i} today{i}." for i in range(12))
    rows = [(1, prose), (2, "\n".join([prose, "We use cookies. Read more."])), (3, "\n".join(f"Please enable JavaScript now {i}." for i in range(30)))]
    got = {r.doc_id: (r.kept, r.lost_chars > 0) for r in quality_report(docs(rows)).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, True)}


def test_verdicts_on_labels(spark, sf_dir, corpus):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_report(corpus).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_cleaning(docs):
    prose = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(8))
    rows = [(1, prose + "\nHome | News | About | Contact\nAll rights reserved."), (2, "| a | b | c |\n" * 60), (3, None)]
    df = docs(rows, extra=True).withColumn("n_chars", F.lit(0).cast("long"))
    got = clean_documents(df).collect()
    assert [r.doc_id for r in got] == [1] and got[0].text == prose and got[0].n_chars == len(prose) and clean_documents(df).columns == df.columns


def test_compression_score(spark, sf_dir, corpus):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = remainder(F.col("doc_id"), 5) == 0
    rows = score(corpus, fit(corpus, labels, ~held), held).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.85 * len(good) * len(bad)
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.95 * len(good)


def test_score_without_labels_or_text(spark, docs, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (3, "word"), (None, "word"), (3, "word")]
    got = score(docs(rows, extra=True), fit(corpus, none, F.lit(True)), F.lit(False)).collect()
    assert [r.score for r in got] == [0.5] * 5 and all(r.predicted == 1 for r in got)
    one = spark.createDataFrame([(i, 0) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert all(r.predicted == 0 for r in score(docs(rows), fit(corpus, one, F.lit(True)), F.lit(False)).collect())
    assert score(docs([]), fit(corpus, none, F.lit(True)), F.lit(False)).count() == 0


def test_letters_that_end_like_a_separator(docs):
    lines = {
        "ru": "Летом люди любили долго гулять вдоль реки, слушали волны и ловили мелкую рыбу до темноты, пока солнце не село за лес {}.",
        "el": "Όλα τα καλά βιβλία λένε πολλά για τη ζωή, αλλά ο λόγος του λαού μιλά πάλι για άλλα παλιά και μεγάλα πελάγη {}.",
        "vi": "Việt Nam hiện có nhiều bệnh viện hiện đại, nhưng việc điều trị những bệnh hiểm nghèo vẫn là nhiệm vụ lớn của mọi tỉnh miền núi {}.",
    }
    lines = {name: line.replace(" {}", "").split() for name, line in lines.items()}
    texts = ["\n".join(" ".join(f"{w}{i}" if j % 3 == 0 else w for j, w in enumerate(words[:-1])) + f" {words[-1]}" for i in range(6)) for words in lines.values()]
    menu = "Home » News » About » Contact » Imprint."
    rows = list(enumerate(texts)) + [(9, texts[0] + "\n" + menu)]
    got = {r.doc_id: r for r in quality_report(docs(rows)).collect()}
    assert all(got[i].kept and got[i].lost_chars == 0 for i in range(3))
    assert got[9].kept and got[9].lost_chars == len(menu.replace(" ", ""))
    assert {r.doc_id: r.text for r in clean_documents(docs(rows)).collect()} == {**dict(rows), 9: texts[0]}


def test_scores_of_every_row_against_a_plain_loop(spark, sf_dir, docs, corpus):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(corpus, labels, remainder(F.col("doc_id"), 5) != 0)
    rows = [(r.doc_id, r.text) for r in corpus.where("doc_id < 400").collect()] + [(-1, None), (-2, ""), (-3, "a"), (-4, "é" * 3000), (-5, "word " * 60_000)]
    text = dict(rows)
    by = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for k, d in (("good", model.good), ("bad", model.bad))}
    got = score(docs(rows, extra=True), model, F.lit(False)).collect()
    assert len(got) == len(rows)
    for r in got:
        data, size = (text[r.doc_id] or "").encode(), {}
        for k, c in by.items():
            size[k] = 0
            for at in range(0, len(data), quality_model.PIECE):
                size[k] += len(c.compress(data[at : at + quality_model.PIECE]))
        difference = (size["bad"] - size["good"]) / (size["bad"] + size["good"]) if data else 0.0
        p = 1 / (1 + math.exp(-max(-30, min(30, model.slope * difference + model.at_zero))))
        assert abs(r.size_difference - difference) < 1e-12 and abs(r.score - p) < 1e-9 and r.predicted == (p >= 0.3), r.doc_id


def test_the_sample_bounds_rows_alone(spark):
    rows = [(i, "x" * 30_000 if i % 3 else f"text {i}") for i in range(300)] + [(7, "again")] * 500 + [(None, "null")] * 50 + [(8, None), (9, "")]
    texts, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)] * 2 + [(7, 0)], "doc_id long, quality int")
    got = quality_model.sampled(texts, labels, 40).groupBy("quality").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).collect()
    assert {r.quality: r.n for r in got} == {0: 80, 1: 80} and all(r.longest == 30_000 for r in got)
    every = quality_model.sampled(texts, labels, 1000).collect()
    assert len(every) == 301 and sum(r.text in ("again", "x" * 30_000) for r in every) >= 200


def test_labels_are_cut_where_they_are_read(spark):
    from lumenark.llm.quality_model import sampled

    n = 30_000
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as quality")
    texts = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text")
    rows = sampled(texts, labels.union(labels), 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.rindex("CASE WHEN") > plan.rindex("Window")  # the threshold is below the window
    got = rows.collect()
    by = {q: sorted(r.h for r in got if r.quality == q) for q in (0, 1)}
    hashes = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as h").collect()}
    assert all(by[q] == sorted(h for i, h in hashes.items() if (i % 10 == 0) == q)[:200] for q in by)
