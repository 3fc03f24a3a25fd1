"""The streaming operator gives the batch operator's rows."""

from lumenark.operators.events import sessionize
from lumenark.sources.sinks import append_query_log, append_result_set, markdown, read_manifest, result_sets, write_metrics, write_vectors
from lumenark.sources.tables import captures, load
from lumenark.streaming.sessions import sessionized


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = captures(spark, sf_dir).where("user_id < 12")
    ordered = rows.orderBy("captured_ms", "id").collect()
    for i in range(4):
        part = ordered[i * len(ordered) // 4 : (i + 1) * len(ordered) // 4]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessionized(stream).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.id, r.session) for r in spark.table("sessions").collect() if not r.late}
    assert got == {(r.id, r.session) for r in sessionize(rows).collect()}


def test_late_captures_are_given_as_late(spark, sf_dir, tmp_path):
    rows = captures(spark, sf_dir).where("user_id = 1").orderBy("captured_ms", "id").limit(12).collect()
    schema = captures(spark, sf_dir).schema
    for part in ([*rows[:4], *rows[6:]], rows[4:6]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessionized(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("late").collect()
    assert len(got) == 12 and {r.id for r in got if r.late} == {r.id for r in rows[4:6]} and all((r.session is None) == r.late for r in got)


def test_query_log_and_markdown(spark, tmp_path):
    from pyspark.sql import functions as F

    turn = spark.sql("""SELECT 's1' AS session_id, 'red cars' AS query, 'COUNT' AS intent, array('red', 'car') AS terms, array(named_struct('channel', 'lexical', 'status', 'SUCCESS', 'searched', 3, 'eligible', 4)) AS channels,
        2L AS results, 15L AS elapsed_ms, 1700000000000L AS created_ms, 7L AS set_id, CAST(NULL AS BIGINT) AS parent_id""")
    append_query_log(turn, str(tmp_path / "log"))
    append_query_log(turn, str(tmp_path / "log"), protect=lambda c: F.sha2(c, 256))
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(got) == 2 and {r.query == "red cars" for r in got} == {True, False}
    assert next(r for r in got if r.query == "red cars").plan_summary == "COUNT:red,car|channels=lexical:SUCCESS:3/4"
    lines = [r.line for r in markdown(spark.createDataFrame([("b|c", 1.5), ("a", None)], "name string, value double")).collect()]
    assert lines == ["| name | value |", "|---|---|", "| a |  |", "| b\\|c | 1.5 |"]


def test_sinks(spark, sf_dir, tmp_path):
    write_metrics(spark.createDataFrame([("f1", 0.5)], "name string, value double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "json")).first().value == 0.5
    v = load(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding")
    write_vectors(v, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == v.count()
    assert append_result_set(v.select("id").limit(3), str(tmp_path / "r"), "s1", 1, 10, None)
    assert append_result_set(v.select("id").limit(2), str(tmp_path / "r"), "s1", 2, 20, 1)
    assert not append_result_set(v.select("id").limit(2), str(tmp_path / "r"), "s1", 3, 30, 1)  # 2 is the latest by now
    assert result_sets(spark, str(tmp_path / "r"), "s1").groupBy("set_id").count().orderBy("set_id").collect() == [(1, 3), (2, 2)]
    assert result_sets(spark, str(tmp_path / "r"), "s2") is None
    (tmp_path / "manifest.json").write_text('[{"id": 1, "title": "a", "tags": ["x"]}]')
    assert read_manifest(spark, str(tmp_path / "manifest.json")).first().title == "a"
