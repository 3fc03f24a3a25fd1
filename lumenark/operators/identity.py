"""Identity clusters over face vectors: decisions for new faces, expansion of reviewed clusters, refinement."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import checkpointed
from .retrieval import dot

# Thresholds of the cluster decision, of identity expansion, and of refinement.
MIN_SCORE, SUPPORT, STRONG, MARGIN, NEIGHBOURS = 0.45, 0.40, 0.58, 0.05, 12
EXPAND_STRONG, EXPAND_SECOND, EXPAND_MEAN, SEEDS = 0.58, 0.46, 0.50, 8
KEEP = 0.42
#: Queries that ``similarities`` takes, and bytes of vectors that a round of ``nearest_faces`` sends to the tasks.
FEW, ROUND_BYTES = 256, 64 << 20


def similarities(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Dot products of unit vectors: every query with every reference.

    ``queries`` (query_id, vector) is a small set, as the seeds of a cluster; its size is checked before it is sent to the tasks,
    and more than ``FEW`` are an error (``nearest_faces`` takes any number).
    """
    if len(queries.limit(FEW + 1).collect()) > FEW:
        raise ValueError(f"more than {FEW} queries")
    q = F.broadcast(queries.select("query_id", F.col("vector").alias("q")))
    return references.crossJoin(q).select("query_id", references["*"], dot(F.col("vector"), F.col("q")).alias("score"))


def nearest_faces(queries: DataFrame, references: DataFrame, k: int = NEIGHBOURS, digits: int = 6, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(query_id, face_id, cluster_id, score): the k nearest references (face_id, cluster_id, vector) of each query (query_id, vector), but itself.

    Queries go in rounds of so many bytes of vectors, each a block that is sent to the tasks; a task multiplies its
    references by the block as matrices and keeps k of each query. So what leaves a task is k rows a query, and a round is one
    pass over the references. Vectors that are null or of another length than the queries' are in no result.
    """
    spark = references.sparkSession
    q = checkpointed(queries.where("vector is not null").select("query_id", "vector"))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((references, "face_id"), (queries, "query_id")))
    schema = f"query_id {query_kind}, face_id {id_kind}, score double"
    if not size.n:
        return spark.createDataFrame([], f"query_id {query_kind}, face_id {id_kind}, cluster_id {references.schema['cluster_id'].dataType.simpleString()}, score double")
    rounds = max(1, -(-size.n * size.d * 8 // round_bytes))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "face_id")
    found = None
    for r in range(rounds):
        block = q.where((F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) & (F.size("vector") == size.d)).collect() if rounds > 1 else q.where(F.size("vector") == size.d).collect()  # a round's bytes
        if not block:
            continue
        sent = spark.sparkContext.broadcast(([x.query_id for x in block], np.array([x.vector for x in block], np.float64)))
        part = references.select("face_id", "vector").mapInArrow(_nearest(sent, k, digits), schema)
        part = written(part.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= k).drop("_p"), "near")
        found = part if found is None else found.unionByName(part)
    return found.join(references.select("face_id", "cluster_id"), "face_id").select("query_id", "face_id", "cluster_id", "score")


def _nearest(sent, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, block = sent.value
        own = {name: i for i, name in enumerate(names)}
        best: list[list[tuple]] = [[] for _ in names]  # of each query (-score, id), the k least
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), block.shape[1]), False)
            part = batch.filter(right)
            for lo in range(0, part.num_rows, 1024):
                some = part.slice(lo, 1024)
                ids = some.column(0).to_pylist()
                vectors = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, block.shape[1])
                scores = np.round(vectors @ block.T, digits)
                for i, face in enumerate(ids):
                    if face in own:
                        scores[i, own[face]] = -np.inf
                least = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best])
                for i, j in zip(*np.nonzero((scores >= least) & np.isfinite(scores)), strict=True):
                    insort(best[j], (-scores[i, j], ids[i]))
                    del best[j][k:]
        rows = [(names[j], face, -s) for j, b in enumerate(best) for s, face in b]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.float64())], names=["query_id", "face_id", "score"])

    return run


def nearest_clusters(scores: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The cluster of each query from its k nearest references (query_id, face_id, cluster_id, score), or null.

    The best score must reach 0.45, be supported by two of at least 0.40 or be 0.58 itself, and lead the runner-up's by 0.05.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("face_id")))
    near = scores.withColumn("_p", place).where(F.col("_p") <= k)
    by = near.where("cluster_id is not null").groupBy("query_id", "cluster_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= SUPPORT).alias("support"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("cluster_id")))
    ranked = by.withColumn("r", rank).where("r <= 2").groupBy("query_id").agg(
        F.min_by("cluster_id", "r").alias("cluster_id"), F.max("best").alias("best"), F.min_by("support", "r").alias("support"), F.max(F.when(F.col("r") == 2, F.col("best"))).alias("second")
    )
    ok = (F.col("best") >= MIN_SCORE) & ((F.col("support") >= 2) | (F.col("best") >= STRONG)) & F.coalesce(F.col("best") - F.col("second") >= MARGIN, F.lit(True))
    return ranked.select("query_id", F.when(ok, F.col("cluster_id")).alias("cluster_id"), "best", "support")


def expansion(scores: DataFrame) -> DataFrame:
    """Faces that join a reviewed cluster, from their scores with its seeds (face_id, score): one strong, or two good ones."""
    top = scores.groupBy("face_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 2).alias("s"))  # at most eight seeds
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    ok = (first >= EXPAND_STRONG) | F.coalesce((second >= EXPAND_SECOND) & ((first + second) / 2 >= EXPAND_MEAN), F.lit(False))
    return top.where(ok).select("face_id", first.alias("best"))


def refined(members: DataFrame) -> DataFrame:
    """Members (face_id, cluster_id, representative, corrected, score): kept, or moved to a hidden cluster."""
    keep = (F.col("face_id") == F.col("representative")) | F.col("corrected") | F.col("score").isNull() | (F.col("score") >= KEEP)
    return members.withColumn("kept", keep).withColumn("cluster_id", F.when(keep, F.col("cluster_id").cast("string")).otherwise(F.concat(F.lit("quarantine:"), F.col("cluster_id").cast("string"))))


def cluster_summaries(faces: DataFrame, clusters: DataFrame, least: int = 5) -> DataFrame:
    """Faces, items and the latest item of each visible cluster; unreviewed ones need ``least`` items."""
    by = faces.groupBy("cluster_id").agg(F.count("*").alias("faces"), F.count_distinct("media_id").alias("items"), F.max_by("media_id", F.struct("captured_ms", "media_id")).alias("latest_id"))
    return clusters.where("not hidden").join(by, "cluster_id").where(F.col("reviewed") | (F.col("items") >= least)).select("cluster_id", "label", "reviewed", "faces", "items", "latest_id")


def people_of_media(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Reviewed, visible people of each item with their number of faces."""
    seen = clusters.where("reviewed and not hidden").select("cluster_id", "label")
    return faces.join(seen, "cluster_id").groupBy("media_id", "cluster_id", "label").agg(F.count("*").alias("faces"))


def verification_labels(faces: DataFrame) -> DataFrame:
    """P1, P2, … for reviewed faces by cluster in the order first seen from the left; U1, … for the others."""
    left = F.struct("left", "face_id")
    known = Window.partitionBy("media_id", "reviewed", "cluster_id")
    first = F.when(F.col("reviewed"), F.min(left).over(known)).otherwise(left)
    number = F.dense_rank().over(Window.partitionBy("media_id", "reviewed").orderBy("_first"))
    return faces.withColumn("_first", first).withColumn("n", number).select("media_id", "face_id", F.concat(F.when(F.col("reviewed"), "P").otherwise("U"), F.col("n").cast("string")).alias("name"))


def merged_clusters(clusters: DataFrame, source: Column, target: Column) -> DataFrame:
    """Aliases of clusters after a merge: those of both, each once, 16 at most."""
    into = F.when(F.col("cluster_id") == source, target).otherwise(F.col("cluster_id"))
    own = (F.col("cluster_id") == target).cast("int")
    both = clusters.withColumn("into", into).groupBy("into").agg(F.sort_array(F.collect_list(F.struct(F.negative(own).alias("o"), "aliases"))).alias("a"), F.max_by("label", own).alias("label"))
    return both.select(F.col("into").alias("cluster_id"), "label", F.slice(F.array_distinct(F.flatten("a.aliases")), 1, 16).alias("aliases"))


def kept_corrections(new_faces: DataFrame, old_faces: DataFrame) -> DataFrame:
    """Detected faces of an item replace the old ones, but a cluster that a user has set stays; boxes must lie in [0, 1]."""
    old = old_faces.where("corrected").select("face_id", F.col("cluster_id").alias("set_id"))
    ok = " and ".join(f"{s} between 0 and 1" for s in ("box.left", "box.top", "box.right", "box.bottom"))
    joined = new_faces.where(ok).join(old, "face_id", "left")
    return joined.select("media_id", "face_id", F.coalesce("set_id", "cluster_id").alias("cluster_id"), F.col("set_id").isNotNull().alias("corrected"))


def nearest_face(scores: DataFrame) -> DataFrame:
    """The single nearest face of each question (query_id, face_id, score); of equal ones that of the least id."""
    return scores.groupBy("query_id").agg(F.max_by("face_id", F.struct("score", F.negative("face_id"))).alias("face_id"), F.max("score").alias("score"))


def first_faces(faces: DataFrame, n: int) -> DataFrame:
    """The n best faces of each cluster, by quality, then id."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("quality"), "face_id"))
    return faces.withColumn("place", place).where(F.col("place") <= n)


def face_page(faces: DataFrame, cluster_id: int, limit: int, offset: int) -> DataFrame:
    """A page of a cluster's faces, by quality, then id."""
    return faces.where(F.col("cluster_id") == cluster_id).orderBy(F.desc("quality"), "face_id").offset(offset).limit(limit)


def edited_clusters(clusters: DataFrame, edits: DataFrame) -> DataFrame:
    """Clusters (cluster_id, label, relationship, reviewed, hidden) after edits (cluster_id, action, label, relationship).

    REVIEW sets label and relationship, HIDE hides, UNLABEL takes label, relationship and review away. Only one cluster may be
    ``me``: a review as ``me`` takes it from the one that was.
    """
    e = edits.select("cluster_id", F.col("action"), F.col("label").alias("_label"), F.col("relationship").alias("_relationship"))
    takes = e.where("action = 'REVIEW' and lower(_relationship) = 'me'").agg(F.max("cluster_id").alias("_me"))
    j = clusters.join(e, "cluster_id", "left").crossJoin(F.broadcast(takes))  # one row
    act = lambda a: F.coalesce(F.col("action") == a, F.lit(False))
    loses = F.col("_me").isNotNull() & (F.col("_me") != F.col("cluster_id")) & F.coalesce(F.lower("relationship") == "me", F.lit(False))
    gone = act("UNLABEL")
    return j.select(
        "cluster_id", F.when(act("REVIEW"), F.col("_label")).when(gone, F.lit(None)).otherwise(F.col("label")).alias("label"),
        F.when(act("REVIEW") & ~((F.lower("_relationship") == "me") & (F.col("cluster_id") != F.col("_me"))), F.col("_relationship")).when(act("REVIEW") | gone | loses, F.lit(None)).otherwise(F.col("relationship")).alias("relationship"),
        F.when(act("REVIEW"), True).when(gone, False).otherwise(F.col("reviewed")).alias("reviewed"), (F.col("hidden") | act("HIDE")).alias("hidden"),
    )


def moved_faces(faces: DataFrame, moves: DataFrame) -> DataFrame:
    """Faces (face_id, cluster_id, corrected) after a user has moved some (face_id, target): what a user has set counts as corrected."""
    m = moves.groupBy("face_id").agg(F.max("target").alias("_target"))
    moved = F.col("_target").isNotNull()
    return faces.join(m, "face_id", "left").withColumns({"cluster_id": F.coalesce("_target", "cluster_id"), "corrected": F.col("corrected") | moved}).drop("_target")
