"""The kept index against a scan of the texts; what a search reads and a change writes."""

import re

from lumenark.operators import postings as P
from lumenark.operators import retrieval as R
from lumenark.sources import commits


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_like_a_scan_through_changes(spark, tmp_path):
    folder = str(tmp_path / "i")
    rows = {i: " ".join(["the"] * (i % 5) + ["cat", "Dog"][: i % 3] + [f"w{i % 7}", "über"] + ["x"] * (i % 11)) for i in range(300)} | {300: None, 301: "", 302: "cat " * 50_000}
    P.create(table(spark, [*rows.items()]).selectExpr("*", "1 as n", "'q' as term", "2 as bucket"), folder, 8)
    terms = ("the", "cat", "dog", "w3", "nowhere", "cat")

    def same():
        assert scores(P.bm25(spark, folder, terms)) == scores(R.bm25(table(spark, [*rows.items()]), terms))
        assert {r.id for r in P.any_token(spark, folder, ("dog", "w3")).collect()} == {r.id for r in R.any_token(table(spark, [*rows.items()]), ("dog", "w3")).collect()}

    same()
    for changed, removed in (({5: "cat cat", 400: "the new dog"}, [6, 7, 9999]), ({5: None, 6: "back again, dog"}, []), ({}, [302, 400])):
        P.change(spark, folder, table(spark, [*changed.items()]) if changed else None, table(spark, [(i, None) for i in removed]).select("id") if removed else None)
        for i in removed:
            rows.pop(i, None)
        rows.update(changed)
        same()
    _, index = commits.latest(spark, folder)
    # a change writes the rows of the changed items alone
    assert len(index["segments"]) == 4
    assert {r.id for r in spark.read.parquet(f"{folder}/{index['segments'][1]['place']}/postings").select("id").distinct().collect()} == {5, 400}
    P.compacted(spark, folder)
    assert len(commits.latest(spark, folder)[1]["segments"]) == 1
    same()


def test_a_search_reads_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "i")
    P.create(table(spark, [(i, f"w{i} common") for i in range(500)]), folder, 16)
    plan = P.postings(spark, folder, ("w77",))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,w77)]" in plan
    buckets = {r.bucket for r in spark.read.parquet(f"{folder}/{commits.latest(spark, folder)[1]['segments'][0]['place']}/postings").where("term = 'w77'").collect()}
    assert len(buckets) == 1


def test_texts_are_cut_once_and_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    sizes, runs = str(tmp_path / "sizes"), spark.sparkContext.accumulator(0)
    counted = P._counted

    def watched(batches):
        runs.add(1)
        for batch in batches:
            with open(sizes, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield from counted(iter([batch]))

    monkeypatch.setattr(P, "_counted", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(3_000).selectExpr("id", "concat('the w', id % 50) as text").coalesce(1)
    P.create(rows, str(tmp_path / "i"))
    assert runs.value == 1  # layout by ranges ran it once more, to find them
    assert max(map(int, open(sizes).read().split())) <= P.ROWS and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert P.postings(spark, str(tmp_path / "i"), ("the", "w7")).count() == 3_060


def test_empty_and_repeated(spark, tmp_path):
    P.create(table(spark, []), str(tmp_path / "e"))
    assert P.bm25(spark, str(tmp_path / "e"), ("a",)).count() == 0
    P.create(table(spark, [(1, "a"), (1, "a a"), (None, "a b")]), str(tmp_path / "r"))
    assert sorted((r.tf, r.n) for r in P.postings(spark, str(tmp_path / "r"), ("a",)).collect()) == [(1, 1), (1, 2), (2, 2)]
    P.create(table(spark, [(2, "b")]), str(tmp_path / "r"))  # anew
    assert [r.id for r in P.any_token(spark, str(tmp_path / "r"), ("a", "b")).collect()] == [2]
