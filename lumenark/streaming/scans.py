"""Exhaustive scans that go on where they stopped: a predicate over every vector, with kept progress.

The vectors are a folder of files, read as a stream with the ``availableNow`` trigger, some files a batch. The stream's
checkpoint keeps which files are done, and the file sink shows the hits of whole batches only, so a scan that is killed
reads the rest when it runs again, and counts no hit twice. A scan is known by the digest of its question, its model and
the ids it may look at: with other ids it is another scan, which begins anew. A scan that had come to its end begins
anew where the vectors of its ids are no longer those it has seen. What is being run is in a manifest, which only one
of several drivers can write.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import scan_state
from ..sources import commits


@dataclass(frozen=True)
class Scan:
    """State of a scan: the sizes of its scope, what this run has read, and the hits so far (id, score)."""

    scan_id: str
    status: str  # RUNNING, COMPLETE or PARTIAL (at its end, with ids that have no vector)
    eligible: int
    indexed: int
    rows_read: int
    hits: DataFrame

    def match_count(self) -> int | None:
        """The number of matches, which only a scan of the whole scope knows."""
        return self.hits.count() if self.status == "COMPLETE" else None


def exhaustive_scan(
    folder: str, vectors: str, eligible: DataFrame, predicate: Callable[[DataFrame], DataFrame], question: str, model: str,
    parents: DataFrame | None = None, files_a_batch: int = 16, most_batches: int | None = None,
) -> Scan:
    """Runs or goes on with a scan of the vectors (id, embedding) in ``vectors`` that belong to ``eligible`` (id).

    ``predicate`` gives (id, score) of the rows that match; ``parents`` (id, parent) names the item of a frame, whose best score
    counts for it. ``most_batches`` stops a run early, after so many batches or a little later.
    """
    spark = eligible.sparkSession
    known = spark.read.parquet(vectors)
    if parents is not None:
        known = known.join(parents, "id", "left").withColumn("item", F.coalesce("parent", "id"))
    else:
        known = known.withColumn("item", F.col("id"))
    now = scan_state(eligible, known.select(F.col("item").alias("id")), eligible.limit(0), question, model).first()
    place = f"{folder}/{now.scope_hash}"
    version, state = commits.latest(spark, place)
    if state is None or state["status"] != "RUNNING" and state["coverage"] != now.coverage_hash:
        state = {"status": "RUNNING", "coverage": now.coverage_hash, "run": uuid.uuid4().hex}
        eligible.select("id").distinct().write.parquet(f"{place}/{state['run']}/scope")
        if not commits.commit(spark, place, version + 1, state):
            raise RuntimeError(f"another driver has begun the scan {now.scope_hash}")
        version += 1
    run, read = f"{place}/{state['run']}", 0
    if state["status"] == "RUNNING":
        read, done = _stream(spark, vectors, run, predicate, parents, files_a_batch, most_batches)
        if done:
            state = state | {"status": "DONE", "coverage": now.coverage_hash}
            commits.commit(spark, place, version + 1, state)
    kind = eligible.schema["id"].dataType.simpleString()
    try:
        found = spark.read.schema(f"id {kind}, score double").parquet(f"{run}/hits")
    except Exception as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], f"id {kind}, score double")
    status = "RUNNING" if state["status"] == "RUNNING" else now.status
    return Scan(now.scope_hash, status, now.eligible, now.indexed, read, found.groupBy("id").agg(F.max("score").alias("score")))


def _stream(spark, vectors: str, run: str, predicate, parents: DataFrame | None, files_a_batch: int, most_batches: int | None) -> tuple[int, bool]:
    """Rows read, and whether all files are done."""
    scope = spark.read.parquet(f"{run}/scope")
    rows = spark.readStream.schema(spark.read.parquet(vectors).schema).option("maxFilesPerTrigger", files_a_batch).parquet(vectors).select("id", "embedding")
    if parents is not None:
        owned = parents.join(scope, parents.parent == scope.id, "left_semi").select("id").union(scope.select("id"))
        hits = predicate(rows.join(owned, "id", "left_semi")).join(parents, "id", "left").select(F.coalesce("parent", "id").alias("id"), "score").join(scope, "id", "left_semi")
    else:
        hits = predicate(rows.join(scope, "id", "left_semi"))
    writer = hits.select("id", F.col("score").cast("double").alias("score")).writeStream.format("parquet").option("path", f"{run}/hits").option("checkpointLocation", f"{run}/progress")
    query = writer.trigger(availableNow=True).start()
    stopped = False
    while most_batches is not None and query.isActive:
        if sum(p["numInputRows"] > 0 for p in query.recentProgress) >= most_batches:
            stopped = True
            query.stop()
        time.sleep(0.02)
    if not stopped:
        query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress), not stopped
