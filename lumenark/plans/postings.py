"""Search from a kept index of the documents, as it is built and after a change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators.retrieval import top
from ..registry import query
from ..sources.shared import remove, shared_folder, written
from ..sources.tables import load
from .retrieval import BM25_SQL, TERMS

#: Of a hundred documents one gets another text, one goes, and one is added under a new id.
CHANGED_SQL = """changed AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'the end and the ' || reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 100 <> 13
    UNION ALL SELECT doc_id + 100000000, text || ' que' FROM documents WHERE doc_id % 100 = 21)"""


def _searched(spark, items: DataFrame, change=None) -> DataFrame:
    """The best of an index that lives as long as the search."""
    folder = f"{shared_folder(spark)}/lumenark-index-{uuid.uuid4().hex}"
    P.create(items, folder)
    if change:
        change(folder)
    best = written(top(P.bm25(spark, folder, TERMS).withColumn("score", F.round("score", 6)), "score", 50), "best")
    remove(spark, folder)
    return best


@query(f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 50")
def bm25_from_postings(spark, sf_dir) -> DataFrame:
    return _searched(spark, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {CHANGED_SQL}, {BM25_SQL.replace('FROM documents', 'FROM changed')} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 50")
def bm25_after_change(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    again = d.where("id % 100 = 7").withColumn("text", F.concat(F.lit("the end and the "), F.reverse("text")))
    added = d.where("id % 100 = 21").select((F.col("id") + 100_000_000).alias("id"), F.concat("text", F.lit(" que")).alias("text"))
    return _searched(spark, d, lambda folder: P.change(spark, folder, again.unionByName(added), d.where("id % 100 = 13")))
