"""Retrieval and answer metrics."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def per_query(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, F1 at k and reciprocal rank of each question: ``ranked`` (query_id, id, rank), ``relevant`` (query_id, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("good", F.lit(1)), ["query_id", "id"], "left")
    by = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("good").alias("found"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    want = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    n = want.join(by, "query_id", "left").na.fill(0, ["returned", "found"])
    p, r = ratio(F.col("found"), F.col("returned")), ratio(F.col("found"), F.col("relevant"))
    return n.select("query_id", "returned", "found", "relevant", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(queries: DataFrame) -> DataFrame:
    """Macro and micro averages."""
    s = queries.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "rr")], *[F.sum(c).alias(c) for c in ("found", "returned", "relevant")])
    p, r = ratio(F.col("found"), F.col("returned")), ratio(F.col("found"), F.col("relevant"))
    return s.select("macro_precision", "macro_recall", "macro_f1", F.col("macro_rr").alias("mrr"), p.alias("micro_precision"), r.alias("micro_recall"), f1(p, r).alias("micro_f1"))


def by_language(asked: DataFrame, k: int = 5) -> DataFrame:
    """(lang, recall, mrr) of questions (concept, lang, rank of the wanted item or null): the share found within k, and the mean reciprocal rank."""
    return asked.groupBy("lang").agg(F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def rank_spread(asked: DataFrame) -> DataFrame:
    """(concept, spread): between the best and the worst rank of what is asked in several languages; null if one of them doesn't find it."""
    out = asked.groupBy("concept").agg(F.max("rank").alias("worst"), F.min("rank").alias("best"), F.count_if(F.col("rank").isNull()).alias("lost"))
    return out.select("concept", F.when(F.col("lost") == 0, F.col("worst") - F.col("best")).alias("spread"))


def nearest_rank(values: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """Nearest-rank percentiles, exact: the values stay in their partitions."""
    return values.agg(*[F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(f * 100)}") for f in fractions])


def rouge_n(reference: list[str], answer: list[str], n: int) -> float:
    a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (reference, answer))
    if not a or not b:
        return 0.0
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits: as fast as the words fit in integers."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        u = row & at.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def rouge_scores(pairs: DataFrame, reference: str = "reference", answer: str = "answer") -> DataFrame:
    """ROUGE-1, 2 and L (F1) of each row."""
    import re

    def cut(v: str | None) -> list[str]:
        return re.findall(r"\w+", (v or "").casefold())

    def score(refs: pd.Series, answers: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(map(cut, refs), map(cut, answers), strict=True):
            common = longest_common(x, y)
            rows.append((rouge_n(x, y, 1), rouge_n(x, y, 2), 2 * common / (len(x) + len(y)) if common else 0.0))
        return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])

    return pairs.withColumn("rouge", F.pandas_udf(score, "rouge1 double, rouge2 double, rougeL double")(F.col(reference), F.col(answer)))
