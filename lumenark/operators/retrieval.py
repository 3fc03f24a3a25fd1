"""Retrieval channels and their fusion. Every ranking ends with an id, so that ties have one order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import checkpointed

#: Channel weights of the fusion.
CHANNEL_WEIGHTS = {"lexical": 1.0, "event": 0.95, "image_semantic": 0.85, "caption": 0.80, "caption_vector": 0.75}
#: Factors of direct and contextual captions, and the constant of rank fusion.
DIRECT, CONTEXTUAL, RRF_K = 1.0, 0.72, 60
TOKEN = r"[\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def top(df: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    """The k best by score, then by id: a bounded heap in each task, no full sort."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def any_token(items: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Boolean hit set: items that hold any of the terms as a token."""
    wanted = F.array(*map(F.lit, terms))
    return items.where(F.arrays_overlap(tokens(F.col(text)), wanted)).select("id")


def field_score(items: DataFrame, terms: Sequence[str], text_hits: DataFrame | None = None, keyframes: DataFrame | None = None) -> DataFrame:
    """Field-weighted substring score, summed over the terms.

    A keyframe of a video (id, labels, text) that shows a term is 12; a tag equal to a term is 8, else one that holds it or
    lies in it 5; location 7, title 4, description 2, recognised text 10; 3 once for a hit of the token search. Items of score
    0 go; without terms every item has 1.
    """
    if not terms:
        return items.select("id", F.lit(1.0).alias("score"))

    def one(term: str) -> Column:
        t = F.lit(term.lower())
        tag = F.when(F.exists("tags", lambda x: F.lower(x) == t), 8).when(F.exists("tags", lambda x: F.lower(x).contains(t) | t.contains(F.lower(x))), 5).otherwise(0)
        return tag + sum((F.when(F.lower(c).contains(t), w).otherwise(0) for c, w in (("location", 7), ("title", 4), ("description", 2), ("text", 10))), F.lit(0))

    score = sum((one(t) for t in terms), F.lit(0))
    out = items.select("id", "title", "kind", score.alias("points")) if keyframes is not None else items.select("id", "title", score.alias("points"))
    if keyframes is not None:
        def shown(term: str) -> Column:
            t = F.lit(term.lower())
            return F.exists("labels", lambda x: F.lower(x).contains(t) | t.contains(F.lower(x))) | F.lower("text").contains(t)

        # terms that any frame of the clip shows: a row a clip, combined before the shuffle
        points = sum((F.when(F.coalesce(F.bool_or(shown(t)), F.lit(False)), 12).otherwise(0) for t in terms), F.lit(0))
        seen = keyframes.groupBy("id").agg(points.alias("frames"))
        out = out.join(seen, "id", "left").withColumn("points", F.col("points") + F.when(F.col("kind") == "VIDEO", F.coalesce("frames", F.lit(0))).otherwise(0))
    if text_hits is not None:
        out = out.join(text_hits.select("id", F.lit(3).alias("bonus")), "id", "left").withColumn("points", F.col("points") + F.coalesce("bonus", F.lit(0)))
    return out.where("points > 0").select("id", "title", F.col("points").cast("double").alias("score"))


def bm25(items: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """BM25 (k1 1.2, b 0.75) over the terms, with a whole mean length of at least 1.

    A text is cut once, into its length and the frequencies of the terms that are asked for; document frequencies and the
    corpus's size are small aggregates of these.
    """
    def counts(words: Column) -> Column:
        frequency = lambda t: F.size(F.filter(words, lambda w: w == t)).alias("tf")
        found = F.array(*[F.struct(F.lit(t).alias("term"), frequency(t)) for t in dict.fromkeys(terms)])
        return F.struct(F.size(words).alias("n"), F.filter(found, lambda x: x["tf"] > 0).alias("found"))

    # the words are the argument of a function, so that they are cut once; what is kept of a text is a few numbers
    words = checkpointed(items.select("id", F.transform(F.array(tokens(F.col(text))), counts)[0].alias("c")).select("id", "c.*"))
    corpus = words.agg(F.count("*").alias("docs"), F.greatest(F.floor(F.sum("n") / F.count("*")), F.lit(1)).alias("mean"))
    postings = words.select("id", "n", F.explode("found").alias("x")).select("id", "n", "x.*")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))  # a row a term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * 2.2) / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.greatest("n", F.lit(1)) / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: Sequence[float], column: str = "embedding") -> DataFrame:
    """Cosine of each vector with a query, in blocks; vectors that are null, of another length, zero or not finite have none.

    All columns of ``vectors`` go along, so it should hold those that are wanted.
    """
    q = np.asarray(query, np.float64)
    length, at = float(np.sqrt(q @ q)), vectors.columns.index(column)
    schema = T.StructType([*vectors.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = pa.compute.equal(pa.compute.list_value_length(batch.column(at)), len(q)).fill_null(False)
            part = batch.filter(sized)
            block = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            norm = np.sqrt(np.einsum("ij,ij->i", block, block))
            ok = (norm > 0) & np.isfinite(norm) & (length > 0)
            score = (block[ok] @ q) / (norm[ok] * length)
            yield pa.RecordBatch.from_arrays([*part.filter(pa.array(ok)).columns, pa.array(score)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def search_variants(vectors: DataFrame, queries: dict[str, Sequence[float]], k: int, threshold: float) -> DataFrame:
    """(id, score, best): top-k for each variant of a question, then the threshold, then fusion; the best raw score is kept."""
    parts = [top(cosine(vectors, q).select(F.lit(v).alias("channel"), "id", F.round("score", 6).alias("score")), "score", k) for v, q in queries.items()]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    kept = hits.where(F.col("score") >= threshold)
    return fuse(kept).join(kept.groupBy("id").agg(F.max("score").alias("best")), "id")


def fuse(ranked: DataFrame, weights: DataFrame | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ``ranked`` (channel, id, score): each channel is bounded by its top-k before.

    A channel without a weight, or with a negative one, is an error.
    """
    once = ranked.groupBy("channel", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), F.asc("id")))
    placed = once.withColumn("rank", place)
    if weights is None:
        placed = placed.withColumn("weight", F.lit(1.0))
    else:
        wrong = F.raise_error(F.concat(F.lit("no weight of at least 0 for the channel "), F.col("channel")))
        placed = placed.join(F.broadcast(weights), "channel", "left").withColumn("weight", F.when(F.col("weight") >= 0, F.col("weight")).otherwise(wrong))
    return placed.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def channel_weights(spark) -> DataFrame:
    return spark.createDataFrame(list(CHANNEL_WEIGHTS.items()), "channel string, weight double")


def sort_hits(hits: DataFrame, by: str) -> DataFrame:
    """RELEVANCE, CAPTURE_TIME_DESC / ASC (unknown times last), QUALITY (unknown is 0); ties by score, then id."""
    first = {
        "CAPTURE_TIME_DESC": [F.desc_nulls_last("captured_ms")], "CAPTURE_TIME_ASC": [F.asc_nulls_last("captured_ms")],
        "QUALITY": [F.desc(F.coalesce("quality", F.lit(0.0)))],
    }.get(by, [])
    return hits.orderBy(*first, F.desc("score"), F.asc("id"))


def diversify(hits: DataFrame, window: int = 20) -> DataFrame:
    """Round robin over events within the first ``window`` of ranked hits (id, rank, event_id); the rest keep their place.

    Events take turns in the order in which they are first seen; a hit without an event is one of its own.
    """
    key = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("item:"), F.col("id").cast("string")))
    head = hits.where(F.col("rank") <= window).withColumn("key", key)
    turn = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    seen = F.min("rank").over(Window.partitionBy("key"))
    head = head.withColumn("turn", turn).withColumn("seen", seen)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("turn", "seen", "id"))  # at most ``window`` rows
    return head.withColumn("place", place).select("id", "rank", "event_id", "place").unionByName(hits.where(F.col("rank") > window).select("id", "rank", "event_id", F.col("rank").alias("place")))


def search_terms(terms: Sequence[str], drop: Sequence[str] = ()) -> list[str]:
    """Terms of a question for retrieval: lower case, letters, marks and numbers, longer than 1, distinct, 32 at most."""
    import re
    import unicodedata

    cut = lambda t: re.split(r"\s+", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in t.lower()))
    out = list(dict.fromkeys(x for t in terms for x in cut(t) if len(x) > 1))
    return [t for t in out[:32] if t not in drop]
