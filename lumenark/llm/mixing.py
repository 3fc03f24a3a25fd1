"""Mixing sources to target weights by weighted sampling without replacement.

Each source has a target, its share of the mix by weight, of at most so many times its own size; what a source can't take is shared
among the others by weight. A target is reached by complete epochs of the source first, and a fraction of it then: each
document has an exponential key, scaled by its quality weight (Efraimidis and Spirakis: ascending keys are a weighted
sample without replacement); documents are sorted by key within their source, their sizes are summed up from the start,
and those whose middle lies within the rest of the budget are taken, whole. So a source misses its target by half a
document at most, and a document is taken at most once more than there are epochs.

The sums run over ranges of source and key (``operators.ordering``): a source with a third of all words is spread over as many tasks as
it needs. Sources may be many: their ranks and shares are computed on tables, and only sums come to the driver.

Defined results: null and empty texts have the size 0 and are never taken; a null source is a source, the last one; the key
of a null id comes from its text; rows that repeat an id share a key and come one after the other, smaller ones first;
a document without a quality has the middle one, one with several their mean; an empty table gives an empty result;
columns beyond the named ones are ignored (``mixed`` returns all).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NOT_SPACE, blocks, word_bounds
from ..operators.ordering import running_totals
from .shared import written

WEIGHTS, SHARE_PERCENT, EPOCHS, SEED = (3, 1, 2), 150, 2, 2024
#: Tables of up to so many sources are broadcast, larger ones joined by a merge, with the same rows.
BROADCAST_SOURCES = 50_000


def sized(documents: DataFrame) -> DataFrame:
    """``documents`` with ``size``, their number of words; they must not have a column of this name."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(word_bounds(buf, offsets, NOT_SPACE)[2]) for _, _, buf, offsets in blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=[*batch.schema.names, "size"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("size", T.LongType())]))


def exponential(identity: Column, weight: Column, seed: int) -> Column:
    """An exponential variate by the digest of ``identity``, of rate ``weight``."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity)), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)) / weight


def keyed(documents: DataFrame, quality: DataFrame | None, seed: int = SEED, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns`` (all by default) of ``documents`` with ``size`` and ``sample_key``.

    ``quality``: (doc_id, quality from 0 to 1), which makes a document up to four times as likely.
    """
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = sized(documents).withColumn("lk_identity", identity).select(*(columns or documents.columns), "size", "lk_identity")
    key = lambda q: exponential(F.col("lk_identity"), 1 + 3 * F.coalesce(q, F.lit(0.5)), seed)
    if quality is None:
        return rows.withColumn("sample_key", key(F.lit(None).cast("double"))).drop("lk_identity")
    known = quality.where("doc_id is not null").groupBy(F.col("doc_id").alias("lk_id")).agg(F.avg("quality").alias("lk_quality"))
    # rows without an id join with nothing, so they are not dealt by it
    named = rows.where("doc_id is not null").join(known.hint("merge"), F.col("doc_id") == F.col("lk_id"), "left").withColumn("sample_key", key(F.col("lk_quality"))).drop("lk_id", "lk_quality")
    return named.unionByName(rows.where("doc_id is null").withColumn("sample_key", key(F.lit(None).cast("double")))).drop("lk_identity")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``. A round shares out what is left by weight among those that aren't full; rounds end when none fills up."""
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (epochs * F.col("source_size")).alias("most")), "sources")
    budget = share_percent * (ranked.agg(F.sum("source_size")).first()[0] or 0) / 100
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most")
        n, taken, free = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not free:
            break
        n_full, level = n, (budget - (taken or 0)) / free
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))).drop("most", "weight")


def _with_targets(rows: DataFrame, sources: DataFrame, plan: DataFrame) -> DataFrame:
    few = sources.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "lk_source")
    return rows.join(F.broadcast(plan) if few else plan.hint("merge"), F.col("source").eqNullSafe(F.col("lk_source")), "left").drop("lk_source")


def mixture(documents: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, sample_key, source_size, target, copies, taken of each row of ``documents`` (doc_id, source, text)."""
    rows = written(keyed(documents.select("doc_id", "source", "text"), quality, seed, ["doc_id", "source"]), "keyed")
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    order = [F.col("sample_key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    summed = _with_targets(running_totals(rows, order, F.col("size"), "source"), sources, targets(sources, weights, share_percent, epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    some = (F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * (F.col("target") - whole * F.col("source_size")))
    out = summed.withColumn("copies", whole + some.cast("long"))
    return out.select("doc_id", "source", "size", "sample_key", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of the mix: each of ``documents`` as often as it is taken, whole, with all its columns, whatever their names.

    The last document that a source takes of its fraction is an edge, one for each source, and documents are held against it.
    """
    plan = written(mixture(documents, quality, weights, share_percent, epochs, seed), "mixture")
    place = F.struct(F.col("sample_key"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("size"))
    low = F.floor(F.col("target") / F.col("source_size"))
    edges = written(plan.where("source_size > 0").groupBy("source").agg(F.first(low).cast("int").alias("lk_whole"), F.max(F.when(F.col("copies") > low, place)).alias("lk_edge")), "edges")
    # the row is one column, so that no name of the table can clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = _with_targets(keyed(documents.select(row, "doc_id", "source", "text"), quality, seed, ["row", "doc_id", "source"]), edges, edges)
    copies = F.col("lk_whole") + F.coalesce(place <= F.col("lk_edge"), F.lit(False)).cast("int")
    return rows.where(F.col("size") > 0).withColumn("lk_copies", copies).where("lk_copies > 0").withColumn("lk_copy", F.explode(F.sequence(F.lit(1), "lk_copies"))).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
