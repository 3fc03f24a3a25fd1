"""Catalogue maintenance as idempotent batch transforms: import, reconciliation, stages, queues, result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import retry_delay_ms, status_after_failure

LEASE_MS, CAPTION_LEASE_MS, MOST_ATTEMPTS, KEPT_RESULT_SETS = 2 * 60_000, 10 * 60_000, 3, 20
# Stages of an item.
STAGES = ("DISCOVERY", "METADATA", "THUMBNAIL", "VIDEO_KEYFRAMES", "EMBEDDING", "OCR", "FACES", "EVENTS", "ENRICHMENT")


def exif_ms(value: Column, offset: Column, zone: str = "UTC") -> Column:
    """Milliseconds of a strict ``yyyy:MM:dd HH:mm:ss``; an explicit offset wins over the zone; not positive is null."""
    strict = F.when(value.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), value)
    local = F.try_to_timestamp(F.concat(strict, F.lit(" "), F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset).otherwise(F.lit("+00:00"))), F.lit("yyyy:MM:dd HH:mm:ss xxx"))
    ms = F.unix_millis(local)
    if zone != "UTC":
        ms = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), ms).otherwise(F.unix_millis(F.to_utc_timestamp(local, zone)))
    return F.when(ms > 0, ms)


def imported_ids(uris: Column) -> Column:
    return F.concat(F.lit("uri-"), F.sha2(uris, 256))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Existing rows with incoming ones: ``action`` is KEPT (not scanned), TOUCHED (equal), REPLACED or INSERTED."""
    old = existing.select(key, F.struct(*compared).alias("old"))
    new = incoming.select(key, F.struct(*compared).alias("new"))
    j = old.join(new, key, "full_outer")
    action = F.when(F.col("new").isNull(), "KEPT").when(F.col("old").isNull(), "INSERTED").when(F.col("old").eqNullSafe(F.col("new")), "TOUCHED").otherwise("REPLACED")
    return j.select(key, F.coalesce("new", "old").alias("row"), action.alias("action")).select(key, "row.*", "action")


def reconcile(existing: DataFrame, snapshot: DataFrame, covered: list[str], key: str = "id", kind: str = "kind") -> DataFrame:
    """SEEN, DELETED (gone, and its kind was scanned in full) or INACCESSIBLE (gone, but not all was scanned)."""
    seen = snapshot.select(key, F.lit(True).alias("_seen")).distinct()
    state = F.when(F.col("_seen"), "SEEN").when(F.col(kind).isin(covered), "DELETED").otherwise("INACCESSIBLE")
    return existing.join(seen, key, "left").withColumn("state", state).drop("_seen")


def revoked(items: DataFrame, snapshot_ms: int) -> DataFrame:
    """Accessible items last seen at or before the snapshot become inaccessible."""
    gone = (F.col("access") == "ACCESSIBLE") & (F.col("last_seen_ms") <= snapshot_ms)
    return items.withColumn("access", F.when(gone, "INACCESSIBLE").otherwise(F.col("access")))


def removed(items: DataFrame, gone: DataFrame, reason: str, now_ms: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Items without those that are gone, and a tombstone for each of these."""
    left = items.join(gone.select(key).distinct(), key, "left_anti")
    stones = items.join(gone.select(key).distinct(), key, "left_semi").select(key, F.lit(reason).alias("reason"), F.lit(now_ms).cast("long").alias("removed_ms"))
    return left, stones


def missing_stages(items: DataFrame, stages: DataFrame, names: tuple[str, ...] = STAGES) -> DataFrame:
    """Stage rows that items lack: each item has one a stage, so the items are exploded, not joined."""
    wanted = items.select("id", F.explode(F.array(*map(F.lit, names))).alias("stage"))
    return wanted.join(stages.select("id", "stage"), ["id", "stage"], "left_anti").withColumn("status", F.lit("PENDING"))


def claimed(queue: DataFrame, owner: str, now_ms: int, n: int, lease_ms: int = LEASE_MS) -> DataFrame:
    """The first n jobs that are due, with owner, lease and one more attempt; in queue order."""
    due = queue.where(F.col("status").isin("PENDING", "FAILED_RETRYABLE") & (F.coalesce("next_attempt_ms", F.lit(0)) <= now_ms))
    first = due.orderBy(*queue_order()).limit(n)
    return first.withColumns({"status": F.lit("RUNNING"), "owner": F.lit(owner), "lease_ms": F.lit(now_ms + lease_ms).cast("long"), "attempts": F.col("attempts") + 1})


def queue_order() -> list[Column]:
    return [F.desc("priority"), F.desc("user_requested"), F.asc(F.coalesce("next_attempt_ms", F.lit(0))), F.asc("updated_ms"), F.asc("id")]


def recovered(queue: DataFrame, now_ms: int) -> DataFrame:
    """Running jobs without a valid lease are pending again, and the attempt does not count."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_ms").isNull() | (F.col("lease_ms") <= now_ms))
    return queue.withColumns({
        "attempts": F.when(lost, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")),
        "lease_ms": F.when(~lost, F.col("lease_ms")), "status": F.when(lost, "PENDING").otherwise(F.col("status")),
    })


def failed(queue: DataFrame, failures: DataFrame, now_ms: int) -> DataFrame:
    """Jobs that failed (id, permanent), fenced by owner: status by attempts, and the time of the next one."""
    f = failures.select("id", F.col("owner").alias("by"), "permanent", F.lit(True).alias("_f"))
    j = queue.join(f, "id", "left")
    mine = F.coalesce(F.col("_f") & (F.col("owner") == F.col("by")), F.lit(False))
    status = status_after_failure(F.col("attempts"), F.col("permanent"), MOST_ATTEMPTS)
    return j.withColumns({
        "next_attempt_ms": F.when(mine & (status == "FAILED_RETRYABLE"), F.lit(now_ms).cast("long") + retry_delay_ms(F.col("attempts"))).otherwise(F.col("next_attempt_ms")),
        "status": F.when(mine, status).otherwise(F.col("status")),
    }).drop("by", "permanent", "_f")


def completed(queue: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """Jobs done by their owner under a valid lease; late or foreign completions change nothing."""
    d = done.select("id", F.col("owner").alias("by"), F.lit(True).alias("_d"))
    j = queue.join(d, "id", "left")
    ok = F.coalesce(F.col("_d") & (F.col("owner") == F.col("by")) & (F.col("lease_ms") > now_ms) & (F.col("status") == "RUNNING"), F.lit(False))
    return j.withColumn("status", F.when(ok, "COMPLETE").otherwise(F.col("status"))).drop("by", "_d")


def requeued(stages: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """Completed stages whose vector is missing or of another version."""
    have = vectors.where(F.col("producer_version") == version).select("id").distinct()
    return stages.where("status in ('COMPLETE', 'SKIPPED')").join(have, "id", "left_anti").withColumn("status", F.lit("PENDING"))


def latest_vectors(old: DataFrame, new: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Upsert of vectors (id, version, embedding), the latest version of each; only valid ids if given."""
    both = old.unionByName(new).groupBy("id").agg(F.max_by(F.struct("version", "embedding"), "version").alias("v")).select("id", "v.version", "v.embedding")
    return both if valid is None else both.join(valid.select("id").distinct(), "id", "left_semi")


def kept_result_sets(sets: DataFrame, n: int = KEPT_RESULT_SETS) -> DataFrame:
    """The newest n result sets of each session."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_ms"), F.desc("set_id")))
    return sets.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def accepted_results(sets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming sets whose parent is still the latest of the session (or that start one): compare and set."""
    latest = sets.groupBy("session_id").agg(F.max_by("set_id", F.struct("created_ms", "set_id")).alias("latest"))
    return incoming.join(latest, "session_id", "left").where(F.col("parent_id").eqNullSafe(F.col("latest"))).drop("latest")


def priority(reason: Column, user_requested: Column) -> Column:
    """Priority of an enrichment job from its reason."""
    r = F.lower(reason)
    return (
        F.when(r.contains("interactive") | r.contains("query_verification"), 1000).when(r.startswith("personal") & user_requested, 900).when(r.startswith("personal"), 800).when(r.contains("frequent"), 600)
        .when(r.contains("event"), 500).when(r.contains("group") | r.contains("burst") | r.contains("duplicate"), 400).when(user_requested, 700).otherwise(100)
    )


def enrichment_plan(jobs: DataFrame, caps: dict[str, int], most: int = 128) -> DataFrame:
    """Jobs (source, id, score) up to the cap of each source, each id once (the first source counts), ``most`` in all.

    The caps are applied by a rank in each source after a bounded top-k, so no source is sorted as a whole.
    """
    out = None
    for place, (source, cap) in enumerate(caps.items()):
        part = jobs.where(F.col("source") == source).orderBy(F.desc("score"), "id").limit(cap).withColumn("place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    once = out.groupBy("id").agg(F.min_by(F.struct("source", "score", "place"), F.struct("place", F.negative("score"))).alias("j"))
    return once.select("id", "j.*").orderBy("place", F.desc("score"), "id").limit(most)


def scan_state(eligible: DataFrame, indexed: DataFrame, hits: DataFrame, query: str, model: str) -> DataFrame:
    """State of an exhaustive scan: hashes of scope and coverage (they change when the sets do), counts, and status.

    The hashes are sums of the ids' hashes, which do not depend on an order and need no gathering of the ids.
    """
    digest = lambda df: df.select("id").distinct().agg(F.coalesce(F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    e, i = digest(eligible), digest(indexed.join(eligible.select("id"), "id", "left_semi"))
    found = hits.join(eligible.select("id"), "id", "left_semi").agg(F.count_distinct("id").alias("hits"))
    one = e.toDF("eh", "eligible").crossJoin(F.broadcast(i.toDF("ih", "indexed"))).crossJoin(F.broadcast(found))  # a row each
    scope = F.sha2(F.concat_ws("\u001f", F.lit(query), F.lit(model), F.col("eh").cast("string")), 256)
    return one.select(scope.alias("scope_hash"), F.sha2(F.col("ih").cast("string"), 256).alias("coverage_hash"), "eligible", "indexed", "hits", F.when(F.col("indexed") >= F.col("eligible"), "COMPLETE").otherwise("PARTIAL").alias("status"))


def invalidated(captions: DataFrame, refs: DataFrame, edited: DataFrame) -> DataFrame:
    """Captions of items in which an edited cluster appears are stale; their jobs are to run again."""
    hit = refs.join(edited.select("cluster_id").distinct(), "cluster_id", "left_semi").select("media_id", F.lit(True).alias("_hit")).distinct()
    return captions.join(hit, "media_id", "left").withColumn("state", F.when(F.col("_hit"), "STALE").otherwise(F.col("state"))).drop("_hit")


def without_person(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Person facts, references and caption chunks (media_id, cluster_id, …) without those of edited clusters and items; rows about no one stay."""
    return rows.join(edited.select("media_id", "cluster_id").distinct(), ["media_id", "cluster_id"], "left_anti")


def captured_at(exif: Column, taken: Column, modified: Column) -> Column:
    """Capture time of a picked file: from its EXIF, else the date taken, else the time of change; what isn't positive doesn't count."""
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(exif), some(taken), some(modified))


def covered_kinds(scans: DataFrame) -> DataFrame:
    """Kinds whose scan has seen all there is: full permission, and a cursor that came to its end."""
    return scans.groupBy("kind").agg(F.bool_and(F.col("permission") == "FULL").alias("full"), F.bool_and("completed").alias("completed")).where("full and completed").select("kind")


def reset_stages(stages: DataFrame, changed: DataFrame) -> DataFrame:
    """Stages (id, stage, status, attempts) of items that were replaced start anew; DISCOVERY stays done."""
    hit = changed.where("action = 'REPLACED'").select("id", F.lit(True).alias("_hit")).distinct()
    again = F.coalesce("_hit", F.lit(False)) & (F.col("stage") != "DISCOVERY")
    return stages.join(hit, "id", "left").withColumns({"status": F.when(again, "PENDING").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))}).drop("_hit")


def removed_everywhere(items: DataFrame, postings: DataFrame, event_items: DataFrame, gone: DataFrame, reason: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, token postings and event members without what is gone (id), and its tombstones; events left without members go with them."""
    ids = gone.select("id").distinct()
    tombstones = items.join(ids, "id", "left_semi").select("id", F.lit(reason).alias("reason"), F.lit(now_ms).cast("long").alias("removed_ms"))
    return items.join(ids, "id", "left_anti"), postings.join(ids, "id", "left_anti"), event_items.join(ids, "id", "left_anti"), tombstones


def replanned(jobs: DataFrame, plan: DataFrame) -> DataFrame:
    """Jobs (id, status, user_requested, attempts) after a plan (id, user_requested): new ones are inserted, known ones stay, and those that a user asks for and that had failed or ended run again."""
    new = plan.select("id", F.col("user_requested").alias("_asked"), F.lit(True).alias("_planned"))
    j = jobs.withColumn("_known", F.lit(True)).join(new, "id", "full_outer")
    known, asked = F.coalesce("_known", F.lit(False)), F.coalesce("_asked", F.lit(False))
    again = known & asked & F.col("status").isin("COMPLETE", "FAILED", "AUTH_REQUIRED")
    return j.select(
        "id", F.when(~known | again, "PENDING").otherwise(F.col("status")).alias("status"), (F.coalesce("user_requested", F.lit(False)) | asked).alias("user_requested"), F.when(~known | again, 0).otherwise(F.col("attempts")).alias("attempts"),
    )


def completion_frames(queue: DataFrame, results: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """What the completion of a batch writes, all behind one fence: owner, running, unexpired lease.

    ``results`` (id, owner, generation, facts, caption, refs, chunks) hold what a job has made; late or foreign ones write
    nothing in any of the tables, so a reader of one generation sees all of it or none.
    """
    alive = queue.where((F.col("status") == "RUNNING") & (F.col("lease_ms") > now_ms)).select("id", "owner")
    ok = results.join(alive, ["id", "owner"], "left_semi")
    part = lambda c: ok.select("id", "generation", F.explode(c).alias("value"))
    return {
        "facts": part("facts"), "captions": ok.select("id", "generation", F.col("caption").alias("value")), "refs": part("refs"), "chunks": part("chunks"),
        "stages": ok.select("id", "generation", F.lit("COMPLETE").alias("value")),
    }


def versioned_completion(chunks: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """Chunk embeddings done by (chunk_id, owner, producer_version): only the owner of a running, unexpired lease of the same version completes one."""
    d = done.select("chunk_id", F.col("owner").alias("_by"), F.col("producer_version").alias("_version"))
    ok = (F.col("_by") == F.col("owner")) & (F.col("_version") == F.col("producer_version")) & (F.col("lease_ms") > now_ms) & (F.col("status") == "RUNNING")
    return chunks.join(d, "chunk_id", "left").withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "COMPLETE").otherwise(F.col("status"))).drop("_by", "_version")
