"""Search over caption chunks: current chunks, prefix and phrase matches, fusion over the variants of a question, fallback."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import checkpointed
from .ordering import running_totals
from .retrieval import CONTEXTUAL, DIRECT, RRF_K, tokens

VARIANTS, TERMS, LIMIT = 8, 16, 500
#: Words that a caption search ignores.
STOP_WORDS = (
    "show", "photos", "photo", "pictures", "picture", "images", "image", "with", "where",
    "that", "this", "from", "have", "wearing", "please", "some", "में", "वाली", "दिखाओ",
)
#: How a chunk's person binding is marked when it no longer holds.
STALE = "STALE_PERSON_BINDING"
#: Columns in which a chunk must equal its caption to be current; the generation may be null on both sides.
CURRENT = (("scope", "scope"), ("scope_id", "subject_id"), ("media_id", "evidence_media_id"), ("evidence_media_id", "evidence_media_id"),
           ("caption_model_version", "model_version"), ("caption_prompt_version", "prompt_version"))


def clamped(value: int, low: int = 1, high: int = 100) -> int:
    """Limits of a question lie in 1 to 100; the k of a retrieval in 20 to 100."""
    return max(low, min(high, value))


def variants(queries: Sequence[str]) -> list[str]:
    """The variants of a question, distinct without case, eight at most."""
    once: dict[str, str] = {}
    for q in map(str.strip, queries):
        if q:
            once.setdefault(q.lower(), q)
    return list(once.values())[:VARIANTS]


def terms(query: str) -> list[str]:
    """Terms of a variant: longer than two, no stop words, distinct, sixteen at most."""
    import unicodedata

    words = re.split(r"\s+", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in query.lower()))
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOP_WORDS))[:TERMS]


def current(chunks: DataFrame, captions: DataFrame, policy: str) -> DataFrame:
    """Chunks (chunk_id, caption_id, …) of the policy that still agree with their caption in all columns that matter."""
    same = F.col("c.caption_id") == F.col("cap.caption_id")
    for mine, theirs in CURRENT:
        same &= F.col(f"c.{mine}") == F.col(f"cap.{theirs}")
    same &= F.col("c.generation_id").eqNullSafe(F.col("cap.generation_id"))
    return chunks.where(F.col("chunk_policy_version") == policy).alias("c").join(captions.alias("cap"), same, "left_semi")


def searchable(chunks: DataFrame, clusters: Sequence[int] = ()) -> DataFrame:
    """Chunks whose person binding holds and, where people are asked for, that are about no one else."""
    out = chunks.where(~F.col("applicability").eqNullSafe(F.lit(STALE)))
    return out.where(F.col("cluster_id").isNull() | F.col("cluster_id").isin(list(clusters))) if clusters else out


def has_backlog(captions: DataFrame, chunks: DataFrame, policy: str) -> bool:
    """Whether a caption is to be cut anew or a chunk to be embedded: two tests that stop at the first row."""
    uncut = captions.where((F.coalesce("chunk_policy_version", F.lit("")) != policy) & (F.col("applicability") != STALE))
    open_ = F.col("embedding_state").isin("PENDING", "RUNNING", "FAILED_RETRYABLE") | (F.col("embedding_state") == "COMPLETE") & F.col("embedding_model_version").isNull()
    return not uncut.limit(1).isEmpty() or not chunks.where((F.coalesce("applicability", F.lit("")) != STALE) & open_).limit(1).isEmpty()


def _frequencies(words: Column, asked: list[str]) -> list[Column]:
    """How often the whole phrase (of several terms) and each term, as a prefix, occur in the words."""
    out: list[Column] = []
    if len(asked) > 1:
        at = F.sequence(F.lit(1), F.size(words) - len(asked) + 1)
        phrase = F.array(*map(F.lit, asked))
        n = F.size(F.filter(at, lambda i: F.slice(words, i, len(asked)) == phrase))
        out.append(F.when(F.size(words) >= len(asked), n).otherwise(0))
    prefix = lambda t: F.size(F.filter(words, lambda w: w.startswith(t)))
    return out + list(map(prefix, asked))


def matches(chunks: DataFrame, queries: Sequence[str], text: str = "text") -> DataFrame | None:
    """(chunk_id, variant, score): BM25 of each chunk that matches a variant, its phrase or any term as a prefix; None without terms.

    Each text is cut into words once; only words that an asked term begins are kept for counting, and what is exploded are
    the expressions that occur in a chunk.
    """
    asked = [(i, t) for i, t in enumerate(map(terms, variants(queries))) if t]
    if not asked:
        return None
    def counts(words: Column) -> Column:
        parts = [F.struct(F.lit(v).alias("variant"), F.lit(e).alias("expression"), tf.alias("tf")) for v, t in asked for e, tf in enumerate(_frequencies(words, t))]
        return F.struct(F.size(words).alias("n"), F.filter(F.array(*parts), lambda p: p["tf"] > 0).alias("found"))

    # the words are the argument of a function, so that they are cut once; what is kept of a text is a few numbers
    counted = checkpointed(chunks.select("chunk_id", F.transform(F.array(tokens(F.col(text))), counts)[0].alias("c")).select("chunk_id", "c.*"))
    corpus = counted.agg(F.count("*").alias("docs"), F.greatest(F.floor(F.sum("n") / F.count("*")), F.lit(1)).alias("mean"))
    postings = counted.select("chunk_id", "n", F.explode("found").alias("p")).select("chunk_id", "n", "p.*")
    frequency = postings.groupBy("variant", "expression").agg(F.count("*").alias("df"))  # 136 rows at most
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * 2.2) / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.greatest("n", F.lit(1)) / F.col("mean")))
    scored = postings.join(F.broadcast(frequency), ["variant", "expression"]).crossJoin(F.broadcast(corpus))  # one row
    return scored.groupBy("chunk_id", "variant").agg(F.sum(part).alias("score"))


def fused_variants(scores: DataFrame, limit: int = LIMIT, digits: int = 9) -> DataFrame:
    """(id, score, best): reciprocal rank fusion over variants of the best score of each item in each; ties by id."""
    best = written(scores.groupBy("variant", "id").agg(F.round(F.max("score"), digits).alias("raw")), "best")
    # places are counted over ranges: a variant may hit any share of all items, and an item's term counts however far down it is
    placed = running_totals(best, [F.desc("raw"), F.col("id")], group="variant")
    out = placed.groupBy("id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("before") + 1)), digits).alias("score"), F.max("raw").alias("best"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def to_items(scores: DataFrame, targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scores of chunks brought to the allowed items they speak for (chunk_id, id, direct): direct ones whole, contextual ones by 0.72."""
    factor = F.when(F.col("direct"), DIRECT).otherwise(CONTEXTUAL)
    own = targets.join(allowed.select("id").distinct(), "id", "left_semi")
    return scores.join(own, "chunk_id").select("variant", "id", (F.col("score") * factor).alias("score"))


def vector_hits(hits: DataFrame, targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, score, chunk_id): the best of the vector hits of chunks (chunk_id, score) for each allowed item; direct ones whole, contextual ones by 0.72."""
    own = to_items(hits.select("chunk_id", F.col("chunk_id").alias("variant"), "score"), targets, allowed)
    return own.groupBy("id").agg(F.max("score").alias("score"), F.max_by("variant", F.struct("score", F.negative("variant"))).alias("chunk_id"))


def caption_search(chunks: DataFrame, targets: DataFrame, allowed: DataFrame, queries: Sequence[str], limit: int = LIMIT) -> DataFrame | None:
    """Items by captions: BM25 by variant, fused; None where no variant has a term to search for (the channel isn't required)."""
    found = matches(chunks, queries)
    return None if found is None else fused_variants(to_items(found, targets, allowed), limit)


def caption_fallback(captions: DataFrame, targets: DataFrame, allowed: DataFrame, queries: Sequence[str], limit: int = LIMIT) -> DataFrame | None:
    """The same without postings: the share of a variant's terms that a text holds anywhere. Its answer is PARTIAL."""
    asked = [(i, t) for i, t in enumerate(map(terms, variants(queries))) if t]
    if not asked:
        return None
    body = F.lower(F.col("text"))
    shares = [F.struct(F.lit(v).alias("variant"), (sum((body.contains(x).cast("int") for x in t), F.lit(0)) / float(len(t))).alias("score")) for v, t in asked]
    found = captions.select("chunk_id", F.explode(F.filter(F.array(*shares), lambda s: s["score"] > 0)).alias("s")).select("chunk_id", "s.*")
    return fused_variants(to_items(found, targets, allowed), limit)


def search_or_fall_back(chunks: DataFrame, captions: DataFrame, targets: DataFrame, allowed: DataFrame, queries: Sequence[str], index_ok: bool, limit: int = LIMIT) -> tuple[DataFrame | None, str]:
    """Hits and status: NOT_REQUIRED without terms or allowed items, SUCCESS from the postings, PARTIAL from the fallback."""
    if not any(map(terms, variants(queries))) or allowed.limit(1).isEmpty():
        return None, "NOT_REQUIRED"
    return (caption_search(chunks, targets, allowed, queries, limit), "SUCCESS") if index_ok else (caption_fallback(captions, targets, allowed, queries, limit), "PARTIAL")
