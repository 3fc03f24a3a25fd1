"""Sinks: metrics as JSON and CSV, vectors as Parquet, result sets by session, and a progressive answer."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import KEPT_RESULT_SETS
from . import commits
from .shared import remove


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """A small table of metrics as JSON lines, as CSV and as Markdown."""
    metrics.write.mode("overwrite").json(f"{folder}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    markdown(metrics).select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def write_vectors(vectors: DataFrame, folder: str, files: int = 64) -> None:
    """Vectors (id, embedding) clustered by id, with a check that all have one dimension."""
    sizes = vectors.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError(f"vectors of {sizes.low} to {sizes.high} dimensions")
    vectors.repartitionByRange(files, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON manifest, with the columns of the catalogue; unknown fields are an error, not ignored."""
    from .tables import MEDIA_SCHEMA

    rows = spark.read.option("multiLine", True).json(path)
    extra = set(rows.columns) - set(MEDIA_SCHEMA.names)
    if extra:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    kinds = {f.name: f.dataType for f in MEDIA_SCHEMA}
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in MEDIA_SCHEMA.names])


def _session_folder(folder: str, session_id: str) -> str:
    return f"{folder}/sessions/{hashlib.sha256(session_id.encode()).hexdigest()}"


def append_result_set(hits: DataFrame, folder: str, session_id: str, set_id: int, created_ms: int, parent_id: int | None) -> bool:
    """Ranked ids of a question, appended under its session if ``parent_id`` is still its latest set; False, and nothing kept, if not.

    The rows are written first, to a place of their own, and count once the session's next manifest names them. That is
    created only where it is absent, so of drivers that follow one parent exactly one wins.
    """
    spark, session = hits.sparkSession, _session_folder(folder, session_id)
    version, last = commits.latest(spark, session)
    if (last["sets"][-1]["set_id"] if last else None) != parent_id:
        return False
    place = f"{folder}/sets/{uuid.uuid4().hex}"
    meta = {"session_id": F.lit(session_id), "set_id": F.lit(set_id).cast("long"), "created_ms": F.lit(created_ms).cast("long"), "parent_id": F.lit(parent_id).cast("long")}
    hits.withColumns(meta).write.parquet(place)
    sets = [*(last["sets"] if last else []), {"set_id": set_id, "created_ms": created_ms, "parent_id": parent_id, "place": place}]
    # readers keep the newest sets only
    if commits.commit(spark, session, version + 1, {"session_id": session_id, "sets": sets[-KEPT_RESULT_SETS:]}):
        return True
    remove(spark, place)
    return False


def result_sets(spark: SparkSession, folder: str, session_id: str) -> DataFrame | None:
    """The kept result sets of a session; None where it has none."""
    last = commits.latest(spark, _session_folder(folder, session_id))[1]
    return spark.read.parquet(*[s["place"] for s in last["sets"]]) if last else None


def append_query_log(turns: DataFrame, folder: str, protect=None) -> None:
    """Questions as they were answered (session_id, query, intent, terms, channels, results, elapsed_ms, created_ms, set_id, parent_id), appended by day.

    ``channels`` (channel, status, searched, eligible) become one line; ``protect`` takes the texts before they are stored.
    """
    line = F.array_join(F.transform("channels", lambda c: F.concat(c["channel"], F.lit(":"), c["status"], F.lit(":"), c["searched"].cast("string"), F.lit("/"), c["eligible"].cast("string"))), ",")
    plan = F.concat(F.col("intent"), F.lit(":"), F.array_join("terms", ","), F.lit("|channels="), line)
    kept = protect or (lambda c: c)
    rows = turns.select("session_id", kept(F.col("query")).alias("query"), kept(plan).alias("plan_summary"), "results", "elapsed_ms", "created_ms", "set_id", "parent_id", F.to_date(F.timestamp_millis("created_ms")).alias("day"))
    rows.write.mode("append").partitionBy("day").parquet(folder)


def markdown(metrics: DataFrame) -> DataFrame:
    """A table of metrics as lines of Markdown in order (place, line); its rows are few."""
    names = metrics.columns
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "\\\\|"), F.lit(""))
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = metrics.select(bar([cell(c) for c in names]).alias("line")).orderBy("line")
    head = metrics.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "place long, line string")
    return head.union(body.select(F.monotonically_increasing_id() + 2, "line")).orderBy("place")


def frames(first: DataFrame, final: DataFrame) -> Iterator[tuple[str, DataFrame | None]]:
    """States of an answer as it comes; the frames are lazy."""
    yield "Understanding", None
    yield "PlanReady", None
    yield "InitialResults", first
    yield "Completed", final
