"""A corpus from documents to token ids: clean, deduplicate, decontaminate, redact, encode.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again as the next one's ``docs``. All but the last return the columns
of ``documents``. Tables that a stage makes on its way are removed when its output is written.

Defined results, for every stage: a row with a null id is a document like any other, and is judged by its own text; null
and empty texts have no words, so that ``quality_rules`` drops them; each stage alone keeps them as they are. Texts of any
length are read whole. Rows that repeat an id are judged by their own texts; of equal ones ``near_dedup`` keeps one. Ties
go to the least id. An empty table gives an empty table. Nulls in other columns stay, and so do columns beyond those of
``documents``, whatever their names; ``n_chars`` is counted anew where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenark.llm.bpe import round_trip
from lumenark.llm.decontaminate import decontaminated
from lumenark.llm.near_dedup import deduplicated
from lumenark.llm.pii import redact_documents
from lumenark.llm.quality_rules import clean_documents
from lumenark.llm.queries import vocabulary
from lumenark.llm.shared import passing, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that fail or lose too much."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    return round_trip(docs, vocabulary(), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("byte_bpe", byte_bpe)]

#: Sketches, an estimated span classifier and BPE merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", result=True)
    return docs
