"""Reuse of what a verifier has said before: a tolerance join of face boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from .retrieval import TOKEN

TOLERANCE = 0.02
SIDES = ("left", "top", "right", "bottom")
#: The reach around a corner is a little wider than the tolerance, so that rounding loses no pair. Cells of four tolerances hold the whole
#: reach of half the corners on each axis, so that a row asks 2.25 cells on average.
_REACH, _CELL = TOLERANCE * 1.001, TOLERANCE * 4


def canonical_predicate(text: Column) -> Column:
    """Words of a condition in normal form."""
    return F.array_join(F.regexp_extract_all(nfkc(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), " ")


def asked_cells(wanted: DataFrame) -> DataFrame:
    """Each box with the cells (_x, _y) that its reach touches, one to four."""
    touched = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / _CELL) for d in (-_REACH, _REACH)]))
    return wanted.select("*", F.explode(touched("left")).alias("_x")).select("*", F.explode(touched("top")).alias("_y"))


def within_tolerance(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of ``wanted`` and ``known`` with equal keys and boxes (left, top, right, bottom) that differ by the tolerance at most.

    The boxes' left upper corners lie in a grid; a wanted one asks the cells that its reach touches, one to four, so rows are compared
    only with those of these cells of their keys. A cell with very many rows is a key of a plain join, which Spark splits.
    Columns of ``known`` other than the keys get the prefix ``known_``; a box with a null or missing side is near none.
    """
    cell = lambda c: F.floor(F.col(c) / _CELL)
    there = known.select(*keys, cell("left").alias("_x"), cell("top").alias("_y"), *[F.col(c).alias(f"known_{c}") for c in known.columns if c not in keys])
    near = F.lit(True)
    for side in SIDES:
        near = near & (F.abs(F.col(side) - F.col(f"known_{side}")) <= TOLERANCE)
    return asked_cells(wanted).join(there, [*keys, "_x", "_y"]).where(near).drop("_x", "_y")


def reusable_verdicts(conditions: DataFrame, bindings: DataFrame, facts: DataFrame, prompt_version: str, region_version: str, model_version: str | None = None) -> DataFrame:
    """(media_id, condition_id, verdict, confidence, model_version, fact_id) of the conditions that need not be verified again.

    ``conditions`` (media_id, condition_id, cluster_id, text), ``bindings`` (media_id, cluster_id, box), ``facts`` (fact_id, media_id,
    cluster_id, predicate, verdict, confidence, box, updated_ms, prompt_version, region_version, association, model_version). A
    fact counts if it is about the same person, predicate and face, of the versions in use, and surely the person's; of several
    the latest, then that with the least id. A person who is bound twice in an item is bound to no face.
    """
    single = bindings.groupBy("media_id", "cluster_id").agg(F.count("*").alias("n"), *[F.first(s).alias(s) for s in SIDES]).where("n = 1").drop("n")
    wanted = conditions.where("cluster_id is not null").withColumn("predicate", canonical_predicate(F.col("text"))).join(single, ["media_id", "cluster_id"])
    usable = facts.where((F.col("prompt_version") == prompt_version) & (F.col("region_version") == region_version) & (F.col("association") == "CONFIDENT"))
    if model_version is not None:
        usable = usable.where(F.col("model_version") == model_version)
    usable = usable.withColumn("predicate", canonical_predicate(F.col("predicate")))
    pairs = within_tolerance(wanted.select("media_id", "condition_id", "cluster_id", "predicate", *SIDES), usable, ["media_id", "cluster_id", "predicate"])
    latest = F.max_by(F.struct("known_verdict", "known_confidence", "known_model_version", "known_fact_id"), F.struct("known_updated_ms", F.negative("known_fact_id"), "known_confidence", "known_verdict", "known_model_version"))
    best = pairs.groupBy("media_id", "condition_id").agg(latest.alias("f"))
    return best.select("media_id", "condition_id", F.col("f.known_verdict").alias("verdict"), F.col("f.known_confidence").alias("confidence"), F.col("f.known_model_version").alias("model_version"), F.col("f.known_fact_id").alias("fact_id"))
