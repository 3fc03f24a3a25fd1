"""An inverted index as a table: postings by term, kept up by changed items, and searches that read only the terms asked for.

The index is a list of segments, each with the postings (term, id, tf, n) and the items (id, n) of one build or change; a
manifest names the live segments. Postings are laid out in buckets by the hash of the term, sorted by term, and each bucket is
split over files by the hash of the item, as a term may be in most items: a search reads the buckets of its terms, and of these the row groups that can hold
them. A change writes a segment with the postings of the changed items alone, and voids (id) for what they and removed
items had before; postings of older segments that a later one voids do not count. ``compacted`` makes one segment of all.

Defined results: a null text has no terms and counts as an item; of rows that repeat an id in one build or change each has
its own postings; an empty table gives an index without postings; a term that no item holds has no score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from .retrieval import tokens

BUCKETS, ROWS = 64, 512


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While words go to Python it gets ``ROWS`` texts at a time, so that its memory does not grow with the files that a task reads."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _laid(rows: DataFrame) -> DataFrame:
    """Postings dealt to where they are stored, by hashes: ranges would be found by a first run over all texts."""
    slices = max(1, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS))
    return rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(slices))).sortWithinPartitions("bucket", "term", "id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each row with their frequencies: a row is counted in its task, so the terms are shuffled once, to where they are stored."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            words = part.column(1)
            pairs = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
            counts = pairs.group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
            row, names = counts.column("row").combine_chunks(), ["id", "n", "term", "tf"]
            columns = [part.column(0).take(row), pc.list_value_length(words).take(row).cast(pa.int32()), counts.column("term").combine_chunks(), counts.column("count_all").combine_chunks().cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _segment(items: DataFrame, voids: DataFrame | None, folder: str, buckets: int, text: str) -> dict:
    """Writes a segment and returns its entry of the manifest."""
    place = f"segments/{uuid.uuid4().hex}"
    words = items.select("id", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    words.select("id", F.size("w").alias("n")).write.parquet(f"{folder}/{place}/items")
    kind = items.schema["id"].dataType.simpleString()
    counted = words.mapInArrow(_counted, f"id {kind}, n int, term string, tf int").withColumn("bucket", bucket_of(F.col("term"), buckets))
    with _small_batches(items.sparkSession):
        _laid(counted).write.partitionBy("bucket").parquet(f"{folder}/{place}/postings")
    if voids is not None:
        voids.select("id").distinct().write.parquet(f"{folder}/{place}/voids")
    return {"place": place, "voids": voids is not None}


def create(items: DataFrame, folder: str, buckets: int = BUCKETS, text: str = "text") -> None:
    """An index of ``items`` (id, and a text); what was there before is replaced."""
    kind = items.schema["id"].dataType.simpleString()
    entry = _segment(items, None, folder, buckets, text)
    commits.updated(items.sparkSession, folder, lambda _: {"buckets": buckets, "id": kind, "segments": [entry]})


def change(spark: SparkSession, folder: str, changed: DataFrame | None = None, removed: DataFrame | None = None, text: str = "text") -> None:
    """Items that are new or have a new text (id, and the text), and items that are gone (id); only their rows are written."""
    _, index = commits.latest(spark, folder)
    if index is None:
        raise ValueError(f"no index in {folder}")
    none = spark.createDataFrame([], f"id {index['id']}, {text} string")
    changed = none if changed is None else changed.select("id", text)
    voids = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id"))
    entry = _segment(changed, voids, folder, index["buckets"], text)
    commits.updated(spark, folder, lambda now: now | {"segments": [*now["segments"], entry]})


def _read(spark: SparkSession, folder: str, index: dict, part: str, schema: str) -> DataFrame:
    """The live rows of a part of all segments."""
    segments = index["segments"]
    rows = [spark.read.schema(schema).parquet(f"{folder}/{s['place']}/{part}").withColumn("segment", F.lit(n)) for n, s in enumerate(segments)]
    voids = [spark.read.schema(f"id {index['id']}").parquet(f"{folder}/{s['place']}/voids").withColumn("later", F.lit(n)) for n, s in enumerate(segments) if s["voids"]]
    out = reduce(DataFrame.unionByName, rows)
    if voids:
        last = reduce(DataFrame.unionByName, voids).groupBy("id").agg(F.max("later").alias("later"))
        out = out.join(last, "id", "left").where("later is null or segment >= later").drop("later")
    return out.drop("segment")


def postings(spark: SparkSession, folder: str, terms: Sequence[str], index: dict | None = None) -> DataFrame:
    """(term, id, tf, n) of the terms."""
    index = index or commits.latest(spark, folder)[1]
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    buckets = [r.b for r in wanted.select(bucket_of(F.col("term"), index["buckets"]).alias("b")).distinct().collect()]
    rows = _read(spark, folder, index, "postings", f"id {index['id']}, n int, term string, tf int, bucket int")
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(dict.fromkeys(terms)))).select("term", "id", "tf", "n")


def bm25(spark: SparkSession, folder: str, terms: Sequence[str]) -> DataFrame:
    """(id, score): the scores of ``retrieval.bm25`` from the index."""
    index = commits.latest(spark, folder)[1]
    if index is None:
        raise ValueError(f"no index in {folder}")
    found = postings(spark, folder, terms, index)
    items = _read(spark, folder, index, "items", f"id {index['id']}, n int")
    corpus = items.agg(F.count("*").alias("docs"), F.greatest(F.floor(F.sum("n") / F.count("*")), F.lit(1)).alias("mean"))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))  # a row a term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * 2.2) / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.greatest("n", F.lit(1)) / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def any_token(spark: SparkSession, folder: str, terms: Sequence[str]) -> DataFrame:
    """(id): items that hold any of the terms."""
    return postings(spark, folder, terms).select("id").distinct()


def compacted(spark: SparkSession, folder: str) -> None:
    """One segment of all live rows, for an index that has seen many changes; a change that is committed meanwhile stays behind it."""
    _, index = commits.latest(spark, folder)
    place, known = f"segments/{uuid.uuid4().hex}", len(index["segments"])
    _read(spark, folder, index, "items", f"id {index['id']}, n int").write.parquet(f"{folder}/{place}/items")
    rows = _read(spark, folder, index, "postings", f"id {index['id']}, n int, term string, tf int, bucket int")
    _laid(rows).write.partitionBy("bucket").parquet(f"{folder}/{place}/postings")

    def replaced(now: dict) -> dict:
        if now["segments"][:known] != index["segments"]:
            raise RuntimeError("the index was built anew or compacted meanwhile")
        return now | {"segments": [{"place": place, "voids": False}, *now["segments"][known:]]}

    commits.updated(spark, folder, replaced)
