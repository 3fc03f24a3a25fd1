"""Sources: the driver's tables, and the media catalogue bound to them.

The catalogue is a view over ``documents`` (an item per document: album = source, tags = language and source, text =
recognised text), ``events`` (the event of the same number gives the capture time; the link of the two key spaces is
synthetic) and ``labels`` (quality). Readers take explicit columns, so scans stay pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts) -> "F.Column":
    """Milliseconds since the epoch, rounded down, of a timestamp without zone (UTC)."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1000).cast("long")


def year_range(year: "F.Column", zone: str = "UTC") -> tuple["F.Column", "F.Column"]:
    """Milliseconds at which a calendar year begins in a zone, and at which the next one does."""
    begin = lambda y: F.unix_millis(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(zone)))
    return begin(year), begin(year + 1)


MEDIA_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("album", T.StringType()), T.StructField("location", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()),
        T.StructField("captured_ms", T.LongType()), T.StructField("quality", T.DoubleType()), T.StructField("text", T.StringType()),
    ]
)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events, labels = (load(spark, sf_dir, t) for t in ("documents", "events", "labels"))
    when = events.select(F.col("event_id").alias("doc_id"), epoch_ms("ts").alias("captured_ms"))
    known = labels.select("doc_id", F.col("quality").alias("label"))
    d = F.col("doc_id")
    name = F.when(d % 7 == 0, "Screenshot_").when(d % 11 == 0, "receipt_").otherwise("IMG_")
    kind = F.when(d % 10 == 8, "VIDEO").when(d % 10 == 9, "PDF").otherwise("IMAGE")
    return docs.join(when, "doc_id", "left").join(known, "doc_id", "left").select(
        d.alias("id"), F.concat(name, d.cast("string")).alias("filename"), F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 200).alias("description"),
        F.col("source").alias("album"), F.concat(F.lit("NATION_"), (d % 25).cast("string")).alias("location"), F.array("lang", "source").alias("tags"), kind.alias("kind"),
        "captured_ms", (F.col("label") + (d % 100) / 100.0).alias("quality"), "text",
    )


#: The same view for DuckDB.
MEDIA_SQL = r"""media AS (
    SELECT d.doc_id AS id,
           CASE WHEN d.doc_id % 7 = 0 THEN 'Screenshot_' WHEN d.doc_id % 11 = 0 THEN 'receipt_' ELSE 'IMG_' END || d.doc_id AS filename,
           substr(d.text, 1, 60) AS title, substr(d.text, 61, 200) AS description, d.source AS album, 'NATION_' || (d.doc_id % 25) AS location,
           [d.lang, d.source] AS tags, CASE d.doc_id % 10 WHEN 8 THEN 'VIDEO' WHEN 9 THEN 'PDF' ELSE 'IMAGE' END AS kind,
           epoch_us(e.ts) // 1000 AS captured_ms, l.quality + (d.doc_id % 100) / 100.0::DOUBLE AS quality, d.text AS text
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture stream for sessionization: ``events`` with an album and a place that move with value and type."""
    e = load(spark, sf_dir, "events")
    step = F.floor(F.col("value"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", epoch_ms("ts").alias("captured_ms"), F.col("event_type").alias("album"),
        ((step % 90) * 1.0).alias("latitude"), ((step % 180) * 1.0).alias("longitude"), F.col("value").alias("quality"),
    )


CAPTURES_SQL = """captures AS (
    SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS captured_ms, event_type AS album, (floor(value)::BIGINT % 90)::DOUBLE AS latitude,
           (floor(value)::BIGINT % 180)::DOUBLE AS longitude, value AS quality FROM events)"""
