"""Set algebra over (person, item) pairs and the joins that stand in for in-memory maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def people_scope(presence: DataFrame, clauses: DataFrame) -> DataFrame:
    """Items that satisfy people clauses.

    ``presence`` (person_id, id); ``clauses`` (person_id, grp, must): alternatives of a group are OR, groups AND, and what
    any clause with ``must`` false matches is excluded. The clauses are a question's, so they are few. Every clause is
    a hard one.
    """
    few = F.broadcast(clauses)  # a question has at most eight
    marked = presence.join(few, "person_id").select("id", "grp", "must").distinct()
    groups = clauses.where("must").agg(F.count_distinct("grp").alias("groups"))
    wanted = marked.where("must").groupBy("id").agg(F.count_distinct("grp").alias("n")).join(F.broadcast(groups), F.col("n") == F.col("groups")).select("id")
    return wanted.join(marked.where("not must").select("id").distinct(), "id", "left_anti")


def resolve_people(term: str, clusters: DataFrame, faces: DataFrame, items: DataFrame) -> DataFrame:
    """Accessible items with a usable face of a reviewed, visible cluster that goes by the term."""
    names = clusters.where("reviewed and not hidden").select(
        "cluster_id", F.explode(F.concat(F.array(F.col("cluster_id").cast("string"), "label", "relationship"), "aliases")).alias("name")
    )
    mine = names.where(F.lower(F.trim("name")) == term.strip().lower()).select("cluster_id").distinct()
    return faces.where("usable").join(mine, "cluster_id").select("id").distinct().join(items.where("accessible").select("id"), "id", "left_semi")


def best_parent(children: DataFrame, parents: DataFrame, key: str, score: str, child: str) -> DataFrame:
    """Hits on parts resolved to their whole: the best score of each parent and the child that has it."""
    best = children.groupBy(key).agg(F.max_by(F.struct(F.col(score), F.col(child)), F.struct(F.col(score), F.negative(child))).alias("best"))
    return parents.join(best, key).select(parents["*"], F.col(f"best.{score}").alias(score), F.col(f"best.{child}").alias(child))


def chunk_targets(chunks: DataFrame, duplicates: DataFrame, members: DataFrame) -> DataFrame:
    """Items that a caption chunk speaks for: itself, its exact duplicates, or with it the members of its group or event."""
    own = chunks.where("scope in ('MEDIA', 'QUERY_VERIFICATION', 'VISUAL_GROUP', 'EVENT')").select("chunk_id", F.col("evidence_media_id").alias("id"))
    copies = chunks.where("scope = 'EXACT_DUPLICATE_GROUP'").join(duplicates, "scope_id").select("chunk_id", "id")
    group = chunks.where("scope in ('VISUAL_GROUP', 'EVENT')").join(members, "scope_id").select("chunk_id", "id")
    return own.union(copies).union(group).distinct()


def corroborated(semantic: DataFrame, lexical: DataFrame, event: DataFrame, scoped: bool) -> DataFrame:
    """In a follow-up, semantic hits count only if another channel has them; else they all do."""
    return semantic.join(lexical.select("id").union(event.select("id")).distinct(), "id", "left_semi") if scoped else semantic


def content_classes(items: DataFrame, digest: str = "digest") -> DataFrame:
    """(id, class) of items with content: the least id of equal ones. A row an item, however many copies there are."""
    known = items.where(F.col(digest).isNotNull()).select("id", digest)
    least = known.groupBy(digest).agg(F.min("id").alias("class"))
    return known.join(least, digest).select("id", "class")


def exact_siblings(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, sibling) of the few items that are asked for, each its own sibling too."""
    mine = asked.select("id").distinct().join(classes, "id")
    return mine.join(classes.withColumnRenamed("id", "sibling"), "class").select("id", "sibling")


def shared_facts(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts that exact duplicates share: a row for each class of content and fact, with who gave it; members come from the classes."""
    safe = facts.where("applicability = 'SAFE_FOR_EXACT_DUPLICATES' and scope in ('MEDIA', 'EXACT_DUPLICATE_GROUP')")
    shared = safe.join(classes, "id").groupBy("class", "predicate", "value").agg(F.min("id").alias("given_by"))
    return shared.withColumn("applicability", F.lit("EXACT_DUPLICATE_SHARED"))


def close_boxes(a: Column, b: Column, most: float = 1e-4) -> Column:
    """Whether two boxes (left, top, right, bottom) are the same up to rounding."""
    return F.forall(F.array(*[F.abs(a[s] - b[s]) for s in ("left", "top", "right", "bottom")]), lambda d: d <= most)


def reusable(targets: DataFrame, sources: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, source_id): items whose enrichment can be taken over from an exact duplicate.

    Both sides have ``bindings``, the reviewed faces sorted by label (label, cluster_id, box). A source counts if label,
    cluster and box of all of them agree; of several the latest (``updated_ms``), then the least id. Sources of one content
    with the same bindings are one candidate, so copies don't multiply. Targets are items that have no enrichment yet.
    """
    who = lambda b: F.transform(b, lambda x: F.struct(x["label"].alias("label"), x["cluster_id"].alias("cluster_id")))
    done = sources.join(classes, "id").select("class", who(F.col("bindings")).alias("who"), F.col("bindings").alias("theirs"), F.struct("updated_ms", F.negative("id").alias("order"), F.col("id").alias("source_id")).alias("s"))
    done = done.groupBy("class", "who", "theirs").agg(F.max("s").alias("s"))
    asked = targets.join(classes, "id").select("id", "class", who(F.col("bindings")).alias("who"), "bindings")
    same = asked.join(done, ["class", "who"]).where(F.forall(F.arrays_zip(F.col("bindings").alias("a"), F.col("theirs").alias("b")), lambda x: close_boxes(x["a"]["box"], x["b"]["box"])))
    return same.groupBy("id").agg(F.max(F.struct("s.updated_ms", "s.order", "s.source_id")).alias("s")).select("id", "s.source_id")


def vector_ids(items: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Ids under which vectors are stored: of items, and of keyframes with the mark of a frame."""
    frame = F.concat(F.col("media_id").cast("string"), F.lit("#"), F.col("at_ms").cast("string"))
    return items.select(F.col("id").cast("string").alias("vector_id")).union(keyframes.select(frame)).distinct()


def index_state(indexed: DataFrame, eligible: DataFrame, valid: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, searchable, orphan, missing) of all ids that an index or its catalogue names: indexed and eligible, indexed but not valid, expected but not indexed."""
    mark = lambda df, name: df.select("id", F.lit(name).alias("has"))
    both = mark(indexed, "i").union(mark(eligible, "e")).union(mark(valid, "v")).union(mark(expected, "x"))
    has = both.groupBy("id").agg(*[F.bool_or(F.col("has") == n).alias(n) for n in "ievx"])
    return has.select("id", (F.col("i") & F.col("e")).alias("searchable"), (F.col("i") & ~F.col("v")).alias("orphan"), (F.col("x") & ~F.col("i")).alias("missing"))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    inner = side("left", "right") * side("top", "bottom")
    area = lambda x: (F.col(f"{x}.right") - F.col(f"{x}.left")) * (F.col(f"{x}.bottom") - F.col(f"{x}.top"))
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def match_faces(expected: DataFrame, detected: DataFrame, least: float = 0.35) -> DataFrame:
    """For each expected face the detected one of the same item with the best overlap of at least ``least``."""
    pairs = expected.select("media_id", "face_id", F.col("box").alias("a")).join(detected.select("media_id", F.col("face_id").alias("detected_id"), F.col("box").alias("b")), "media_id")
    scored = pairs.withColumn("iou", overlap("a", "b")).where(F.col("iou") >= least)
    return scored.groupBy("media_id", "face_id").agg(F.max_by("detected_id", F.struct("iou", F.negative("detected_id"))).alias("detected_id"), F.max("iou").alias("iou"))


def merged_evidence(primary: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Evidence of two lists by item, each evidence id once, the primary text first."""
    both = primary.withColumn("source", F.lit(0)).unionByName(supplemental.withColumn("source", F.lit(1)))
    once = both.groupBy("media_id", "evidence_id").agg(F.min_by("text", "source").alias("text"), F.min("source").alias("source"))
    return once.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("source", "evidence_id", "text"))).alias("evidence"))


def closed_citations(primary: DataFrame, supplemental: DataFrame, cited: DataFrame) -> DataFrame:
    """Merged evidence of the primary list and of those supplemental items that hold a cited evidence id (evidence_id); none cited leaves the primary list."""
    holding = supplemental.join(cited.select("evidence_id").distinct(), "evidence_id", "left_semi").select("media_id").distinct()
    return merged_evidence(primary, supplemental.join(holding, "media_id", "left_semi"))
