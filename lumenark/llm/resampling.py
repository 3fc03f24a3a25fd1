"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target.

A task joins the texts of a block of its rows with a separator between them. One pass of a regular expression finds the
words of all of them; the documents' offsets, searched for the starts of the words, tell the document of each word, and mask
the n-grams that would reach over a separator. What is left is hashed into buckets and counted with ``bincount``. The
buckets' counts of all documents and of the target (as many rows as there are buckets, whatever the input) give each
bucket a gain; the gains of a document's n-grams add up to its weight; Gumbel noise by the id turns the highest scores into
a sample drawn in proportion to the weights, without replacement.

Ranks come from ranges of the scores (``operators.ordering``), so neither the driver nor a task holds all drawn documents.

Defined results: null and empty texts have no words, no n-grams and the weight 0; texts of any length are read whole; a
null id has the noise of an empty one and comes after the others among equal scores; rows that repeat an id have the same
noise, and are scored by their own texts and ranked one after the other; of wholly equal rows any is first; an empty
target makes rare n-grams likely, an empty table gives an empty result; documents with too few words are returned with a
null rank; columns beyond the named ones are ignored (``drawn`` returns all).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running_totals
from .shared import written

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
_BLOCK = 1 << 20
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts_of(column: pa.Array, limit: int = _BLOCK) -> Iterator[list[bytes]]:
    """The texts of a batch in UTF-8, in blocks of about ``limit`` bytes."""
    block, size = [], 0
    for text in column.cast(pa.large_binary()):
        raw = text.as_py() or b""
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield block


def features(texts: list[bytes], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and the bucket of each n-gram of 1 to ``max_n`` words, and the number of words of each document."""
    joined = b"\x00".join(texts).lower()  # of bytes: A to Z only
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, starts = [], []
    for found in _WORDS.finditer(joined):
        words.append(found[0])
        starts.append(found.start())
    doc = np.searchsorted(ends, np.array(starts, np.int64), "right")
    hashes = np.fromiter(map(crc32, words), np.int64, len(words))
    docs, found = [doc], [hashes % buckets]
    spaced = [b" " + w for w in words] if max_n > 1 else []
    for n in range(2, max_n + 1):
        hashes = np.fromiter(map(crc32, spaced[n - 1 :], hashes.tolist()), np.int64, max(0, len(words) - n + 1))
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        docs.append(doc[n - 1 :][inside])
        found.append(hashes[inside] % buckets)
    return np.concatenate(docs), np.concatenate(found), np.bincount(doc, minlength=len(texts))


def bucket_counts(texts: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all rows of ``texts`` (text) fall in each bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in texts_of(batch.column(0)):
                total += np.bincount(features(block, max_n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, with one added to each count."""
    s, t, buckets = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, max_n: int = 1, seed: int = SEED) -> DataFrame:
    """``documents`` with n_words, n_features, weight and score; they must not have columns of these names."""
    at, buckets = documents.columns.index("text"), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for block in texts_of(batch.column(at)):
                doc, bucket, n_words = features(block, max_n, buckets)
                out[0].append(n_words)
                out[1].append(np.bincount(doc, minlength=len(block)))
                out[2].append(np.bincount(doc, weights=gain[bucket], minlength=len(block)).astype(np.int64))  # whole numbers: exact
            numbers = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=[*batch.schema.names, "n_words", "n_features", "weight"])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight"))])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return documents.mapInArrow(run, schema).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))


def best_first() -> list:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def resampled(documents: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``documents`` (doc_id, text), resampled towards ``target`` (text).

    ``percent`` of the documents that have ``min_words`` words are drawn; the others' ranks are null.
    """
    docs = documents.select("doc_id", "text")
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = written(weighed(docs, gain, max_n, seed).drop("text"), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = running_totals(able, best_first()).withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("before").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(documents: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``documents`` themselves, with all their columns, whatever their names (rows of equal score and id at the edge all stay).

    Texts aren't shuffled: the last drawn row's score and id are the edge that a pass over the documents filters by.
    """
    docs = documents.select("doc_id", "text")
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    able = F.col("n_words") >= min_words
    scored = written(weighed(docs, gain, max_n, seed).drop("text").where(able), "scored")
    n = percent * scored.count() // 100
    edge = running_totals(scored, best_first()).where(F.col("before") == n - 1).first()
    if edge is None:
        return documents.where(F.lit(False))
    # the row is one column, so that no name of the table can clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = weighed(documents.select(row, "doc_id", "text"), gain, max_n, seed)
    tied = F.lit(True) if edge["doc_id"] is None else F.coalesce(F.col("doc_id") <= F.lit(edge["doc_id"]), F.lit(False))
    kept = rows.where(able & ((F.col("score") > edge["score"]) | (F.col("score") == edge["score"]) & tied))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
