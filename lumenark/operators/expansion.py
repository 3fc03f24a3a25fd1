"""Variants of questions and what abstract words look like: tables of questions joined with a table of concepts.

A concept (term, place, kind, text) says for a word which concrete words are evidence of it (EVIDENCE) and which questions find
it (QUERY), in their place. Questions may be many and so may concepts: their terms are joined, and a question's own few
terms are put together again in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TERMS, MOST_QUERIES, MOST_VARIANTS = 32, 6, 8
# The one concept that is known without a table.
BIRTHDAY = {
    "EVIDENCE": ("cake", "candle", "candles", "balloon", "balloons", "party", "celebration"),
    "QUERY": ("birthday cake", "birthday candles", "birthday party", "birthday celebration"),
}
CONCEPT = "term string, place int, kind string, text string"


def known_concepts(spark) -> DataFrame:
    return spark.createDataFrame([("birthday", n, kind, text) for kind, texts in BIRTHDAY.items() for n, text in enumerate(texts)], CONCEPT)


def _once(values: Column, key=lambda c: c) -> Column:
    """The first of the values that are equal by ``key``, in their order."""
    return F.transform(F.array(values), lambda v: F.filter(v, lambda x, i: F.array_position(F.transform(v, key), key(x)) == i + 1))[0]


def expanded(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """``questions`` (id, terms) with ``evidence_terms``, their terms and then those of their concepts, 32 at most, and ``concept_queries``, 6 at most."""
    asked = questions.select("id", F.posexplode("terms").alias("at", "t")).select("id", "at", F.lower("t").alias("term"))
    found = asked.join(concepts, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "place", "kind", "text"))).alias("found"))
    out = questions.join(found, "id", "left")
    of = lambda kind: F.transform(F.filter(F.coalesce("found", F.array().cast("array<struct<at:int,place:int,kind:string,text:string>>")), lambda x: x["kind"] == kind), lambda x: x["text"])
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    return out.withColumns({"evidence_terms": F.slice(_once(F.concat(terms, of("EVIDENCE"))), 1, MOST_TERMS), "concept_queries": F.slice(_once(of("QUERY"), F.lower), 1, MOST_QUERIES)}).drop("found")


def query_variants(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, place, variant): what is asked of the vectors for each question (id, query, intent, terms, clauses of text, canonical, polarity).

    The question, its positive clauses in both forms, and what its concepts look like; distinct without case, 8 at most;
    none where nothing but a number is asked for, or nothing at all.
    """
    q = expanded(questions, concepts)
    clauses = F.coalesce("clauses", F.array().cast(questions.schema["clauses"].dataType))
    positive = F.filter(clauses, lambda c: (c["polarity"] == "POSITIVE") & (F.coalesce(c["canonical"], c["text"]).rlike(r"[\p{L}\p{M}\p{N}]{2}")))
    said = F.flatten(F.transform(positive, lambda c: F.filter(F.array(c["text"], c["canonical"]), lambda t: t.isNotNull())))
    all_ = F.filter(F.transform(F.concat(F.array("query"), said, F.col("concept_queries")), F.trim), lambda t: t != "")
    asks = ((F.size(clauses) > 0) | (F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0)) & ~(F.col("intent").isin("SUM", "MIN_MAX") & (F.size(clauses) == 0))
    return q.where(asks).select("id", F.posexplode(F.slice(_once(all_, F.lower), 1, MOST_VARIANTS)).alias("place", "variant"))
