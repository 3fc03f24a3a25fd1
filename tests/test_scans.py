"""Exhaustive scans that are killed, gone on with, and begun anew."""

import pathlib

import pytest
from pyspark.errors import StreamingQueryException

from lumenark.streaming.scans import exhaustive_scan


def make(spark, folder, ids, files=5):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "id long, embedding array<float>").repartitionByRange(files, "id").write.mode("append").parquet(folder)


def over(limit):
    return lambda rows: rows.selectExpr("id", "cast(embedding[0] as double) as score").where(f"score >= {limit}")


def scores(scan):
    return {r.id: r.score for r in scan.hits.collect()}


def ids(spark, n):
    return spark.range(n).toDF("id")


def test_a_killed_scan_reads_the_rest(spark, tmp_path):
    vectors, folder, bomb = str(tmp_path / "v"), str(tmp_path / "s"), pathlib.Path(tmp_path / "bomb")
    make(spark, vectors, range(1_000), 6)
    bomb.touch()
    place = str(bomb)

    def explosive(rows):
        def run(batches):
            for batch in batches:
                if pathlib.Path(place).exists() and any(i >= 700 for i in batch.column(0).to_pylist()):
                    raise RuntimeError("killed")
                yield batch

        return over(50)(rows.mapInArrow(run, rows.schema))

    with pytest.raises(StreamingQueryException):
        exhaustive_scan(folder, vectors, ids(spark, 900), explosive, "q", "m", files_a_batch=1)
    bomb.unlink()
    scan = exhaustive_scan(folder, vectors, ids(spark, 900), explosive, "q", "m", files_a_batch=1)
    assert scan.status == "COMPLETE" and 0 < scan.rows_read < 1_000
    assert scores(scan) == {i: float(i) for i in range(50, 900)} and scan.match_count() == 850
    again = exhaustive_scan(folder, vectors, ids(spark, 900), explosive, "q", "m")
    assert again.rows_read == 0 and scores(again) == scores(scan)


def test_stopped_early_then_to_the_end(spark, tmp_path):
    vectors, folder = str(tmp_path / "v"), str(tmp_path / "s")
    make(spark, vectors, range(400), 8)
    first = exhaustive_scan(folder, vectors, ids(spark, 400), over(0), "q", "m", files_a_batch=1, most_batches=1)
    assert first.status in ("RUNNING", "COMPLETE") and (first.match_count() is None or first.status == "COMPLETE")
    last = exhaustive_scan(folder, vectors, ids(spark, 400), over(0), "q", "m", files_a_batch=1)
    assert last.status == "COMPLETE" and last.rows_read + first.rows_read <= 450 and len(scores(last)) == 400


def test_scope_and_coverage(spark, tmp_path):
    vectors, folder = str(tmp_path / "v"), str(tmp_path / "s")
    make(spark, vectors, range(100))
    one = exhaustive_scan(folder, vectors, ids(spark, 100), over(10), "q", "m")
    other = exhaustive_scan(folder, vectors, ids(spark, 50), over(10), "q", "m")  # another scope is another scan
    assert other.scan_id != one.scan_id and other.rows_read == 100 and len(scores(other)) == 40
    assert exhaustive_scan(folder, vectors, ids(spark, 100), over(10), "other", "m").scan_id != one.scan_id
    part = exhaustive_scan(folder, vectors, ids(spark, 120), over(10), "q", "m")
    assert (part.status, part.eligible, part.indexed, part.match_count()) == ("PARTIAL", 120, 100, None)
    make(spark, vectors, range(100, 120), 1)  # the vectors that were missing
    whole = exhaustive_scan(folder, vectors, ids(spark, 120), over(10), "q", "m")
    assert (whole.status, whole.rows_read, len(scores(whole))) == ("COMPLETE", 120, 110)  # begun anew


def test_frames_count_for_their_item(spark, tmp_path):
    vectors, folder = str(tmp_path / "v"), str(tmp_path / "s")
    make(spark, vectors, range(40))
    parents = spark.createDataFrame([(i, i // 2) for i in range(20, 40)], "id long, parent long")
    scan = exhaustive_scan(folder, vectors, ids(spark, 20), over(15), "q", "m", parents)
    assert scores(scan) == {i: float(2 * i + 1) for i in range(10, 20)} and scan.status == "COMPLETE"
