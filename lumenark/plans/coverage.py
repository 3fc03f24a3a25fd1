"""Coverage, progress, integrity, statuses and registries over the driver's tables.

Orders stand for jobs and stages of an item each; which state a row has is a rule on its keys, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..registry import query
from ..sources.tables import load

STATES = ("PENDING", "RUNNING", "COMPLETE", "SKIPPED", "FAILED_RETRYABLE", "FAILED_EXHAUSTED", "FAILED_PERMANENT")
KINDS = ("METADATA", "OCR", "ENRICHMENT", "EMBEDDING", "FACES")
ITEMS_SQL = """items AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'DEMO_ASSET' ELSE 'DEVICE' END AS source_kind, ['READY', 'PENDING', 'INDEXING', 'FAILED_PERMANENT'][o_custkey % 4 + 1] AS index_state,
    CASE WHEN o_orderkey % 3 = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS media_kind, CASE WHEN o_custkey % 5 = 0 THEN 'GONE' ELSE 'ACCESSIBLE' END AS access_state, o_orderkey % 2 AS tags FROM orders)"""
STAGES_SQL = f"""stages AS (SELECT l_orderkey AS id, {list(KINDS)}[l_linenumber] AS stage, {list(STATES)}[(l_orderkey + l_suppkey) % 7 + 1] AS status FROM lineitem WHERE l_linenumber <= 5)"""


def _choice(names: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)


def items(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 9 == 0, "DEMO_ASSET").otherwise("DEVICE").alias("source_kind"), _choice(("READY", "PENDING", "INDEXING", "FAILED_PERMANENT"), c % 4).alias("index_state"),
        F.when(k % 3 == 0, "VIDEO").otherwise("IMAGE").alias("media_kind"), F.when(c % 5 == 0, "GONE").otherwise("ACCESSIBLE").alias("access_state"),
        F.when(k % 2 == 1, F.array(F.lit("tag"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def stages(spark, sf_dir) -> DataFrame:
    """A stage a line; an item has five kinds of stage, and lines beyond the fifth are no stage."""
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_linenumber") <= len(KINDS))
    return rows.select(F.col("l_orderkey").alias("id"), _choice(KINDS, F.col("l_linenumber") - 1).alias("stage"), _choice(STATES, (F.col("l_orderkey") + F.col("l_suppkey")) % 7).alias("status"))


@query(f"""WITH {ITEMS_SQL}, {STAGES_SQL} SELECT count(*) AS eligible, count(*) FILTER (s.status = 'COMPLETE') AS indexed, count(*) FILTER (s.id IS NULL OR s.status IN ('PENDING', 'RUNNING', 'FAILED_RETRYABLE')) AS pending,
    count(*) FILTER (s.status IN ('FAILED_EXHAUSTED', 'FAILED_PERMANENT')) AS failed FROM items m LEFT JOIN stages s ON s.id = m.id AND s.stage = 'FACES'""")
def people_coverage(spark, sf_dir) -> DataFrame:
    return C.people_coverage(items(spark, sf_dir), stages(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, {STAGES_SQL}, j AS (SELECT s.*, i.access_state = 'ACCESSIBLE' AS open, i.media_kind = 'IMAGE' AND i.access_state = 'ACCESSIBLE' AND i.index_state = 'READY' AS ready FROM stages s LEFT JOIN items i USING (id))
    SELECT (SELECT count(*) FROM items) AS discovered, (SELECT count(*) FROM items WHERE source_kind = 'DEMO_ASSET' OR index_state = 'READY') AS ready, (SELECT count(*) FROM items WHERE tags = 1) AS tagged,
    (SELECT count(*) FROM items WHERE index_state IN ('PENDING', 'INDEXING')) AS pending, (SELECT count(*) FROM items WHERE index_state LIKE 'FAILED%') AS failed,
    (SELECT count(*) FROM items WHERE media_kind = 'IMAGE' AND access_state = 'ACCESSIBLE' AND index_state = 'READY') AS face_eligible,
    count(*) FILTER (stage = 'METADATA' AND status IN ('COMPLETE', 'SKIPPED')) AS metadata_ready, count(*) FILTER (stage = 'OCR' AND status IN ('COMPLETE', 'SKIPPED')) AS ocr_ready,
    count(*) FILTER (stage = 'ENRICHMENT' AND status IN ('COMPLETE', 'SKIPPED')) AS labels_ready, count(*) FILTER (stage = 'EMBEDDING' AND open) AS vectors_eligible,
    count(*) FILTER (stage = 'EMBEDDING' AND open AND status = 'COMPLETE') AS vectors_ready, count(*) FILTER (stage = 'EMBEDDING' AND open AND status IN ('PENDING', 'RUNNING', 'FAILED_RETRYABLE')) AS vectors_pending,
    count(*) FILTER (stage = 'EMBEDDING' AND open AND status IN ('FAILED_EXHAUSTED', 'FAILED_PERMANENT')) AS vectors_failed, count(*) FILTER (stage = 'FACES' AND status = 'COMPLETE' AND ready) AS faces_scanned,
    (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS semantic_facts_ready, (SELECT count(*) FROM embeddings) AS video_keyframes_ready, (SELECT count(*) FROM events) AS events FROM j""")
def index_summary(spark, sf_dir) -> DataFrame:
    facts = load(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "MEDIA").otherwise("EVENT").alias("scope"), F.col("doc_id").alias("evidence_media_id"))
    return C.index_summary(items(spark, sf_dir), stages(spark, sf_dir), facts, load(spark, sf_dir, "embeddings").select("vec_id"), load(spark, sf_dir, "events").select("event_id"))


JOB_STATES = ("PENDING", "RUNNING", "COMPLETE", "FAILED", "AUTH_REQUIRED")


@query(f"""WITH jobs AS (SELECT l_orderkey AS media_id, CASE WHEN l_partkey % 3 = 0 THEN 'event' ELSE 'personal:v' || l_partkey % 2 END AS reason, {list(JOB_STATES)}[l_suppkey % 5 + 1] AS status,
      CASE l_linenumber % 4 WHEN 0 THEN 'superseded:m1' WHEN 1 THEN NULL ELSE 'm2' END AS model_version FROM lineitem),
    eligible AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey % 2 = 0), live AS (SELECT * FROM jobs WHERE coalesce(model_version, '') NOT LIKE 'superseded:%'),
    mine AS (SELECT * FROM live WHERE reason LIKE 'personal:%' AND media_id IN (SELECT id FROM eligible))
    SELECT count(*) AS jobs, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'COMPLETE') AS complete, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status = 'AUTH_REQUIRED') AS auth_required, (SELECT count(DISTINCT media_id) FROM mine WHERE status = 'COMPLETE') AS items_complete, (SELECT count(DISTINCT media_id) FROM mine WHERE status IN ('PENDING', 'RUNNING')) AS items_open,
    (SELECT count(DISTINCT media_id) FROM mine WHERE status = 'FAILED') AS items_failed, (SELECT count(DISTINCT media_id) FROM mine WHERE status = 'AUTH_REQUIRED') AS items_auth,
    (SELECT count(*) FROM labels) AS facts, (SELECT count(*) FROM conversations) AS captions, (SELECT count(*) FROM eligible) AS items_eligible FROM live""")
def memory_progress(spark, sf_dir) -> DataFrame:
    jobs = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.when(F.col("l_partkey") % 3 == 0, "event").otherwise(F.concat(F.lit("personal:v"), (F.col("l_partkey") % 2).cast("string"))).alias("reason"),
        _choice(JOB_STATES, F.col("l_suppkey") % 5).alias("status"), F.when(F.col("l_linenumber") % 4 == 0, "superseded:m1").when(F.col("l_linenumber") % 4 == 1, F.lit(None)).otherwise("m2").alias("model_version"),
    )
    eligible = load(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    return C.memory_progress(jobs, eligible, "personal:", load(spark, sf_dir, "labels"), load(spark, sf_dir, "conversations"))


@query("""WITH v AS (SELECT conv_id AS media_id, role AS kind, text AS raw_text, lower(text) AS normalized_value FROM conversations WHERE role IN ('user', 'assistant')), e AS (SELECT media_id, unnest([raw_text, normalized_value]) AS value FROM v)
    SELECT count(DISTINCT media_id) AS checked_media, count(*) AS checked_values, count(DISTINCT media_id) FILTER (NOT coalesce(length(value) % 5 > 0, false)) AS corrupt_media, count(*) FILTER (NOT coalesce(length(value) % 5 > 0, false)) AS corrupt_values FROM e""")
def text_integrity(spark, sf_dir) -> DataFrame:
    """Turns stand for stored texts; one is taken for valid if its length is no multiple of five."""
    values = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("role").alias("kind"), F.col("text").alias("raw_text"), F.lower("text").alias("normalized_value"))
    return C.text_integrity(values, F.length("value") % 5 > 0, ("user", "assistant"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 5 > 0 AS required, o_custkey % 4 AS eligible, o_custkey % 3 AS covered, o_custkey % 2 = 0 AS available, o_orderkey % 3 AS checked, o_orderkey % 7 // 3 AS corrupt, o_orderkey % 2 = 0 AS complete FROM orders)
    SELECT id, CASE WHEN NOT required OR eligible = 0 THEN 'NOT_REQUIRED' WHEN corrupt > 0 AND (complete OR corrupt >= checked) THEN 'FAILED' WHEN corrupt > 0 THEN 'PARTIAL' WHEN covered >= eligible THEN 'SUCCESS' WHEN covered > 0 THEN 'PARTIAL'
      WHEN NOT available THEN 'UNAVAILABLE' ELSE 'PARTIAL' END AS ocr,
      CASE WHEN NOT required THEN 'NOT_REQUIRED' WHEN covered >= eligible THEN 'SUCCESS' WHEN covered > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS event,
      CASE WHEN NOT required OR eligible = 0 THEN 'NOT_REQUIRED' WHEN greatest(covered + 1, 0) < eligible THEN 'PARTIAL' WHEN checked = 0 THEN 'PARTIAL' WHEN corrupt < checked THEN 'PARTIAL' ELSE 'SUCCESS' END AS caption FROM s""")
def channel_statuses(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    required, eligible, covered, checked, corrupt = k % 5 > 0, c % 4, c % 3, k % 3, F.floor(k % 7 / 3)
    return load(spark, sf_dir, "orders").select(
        k.alias("id"), C.ocr_status(required, eligible, covered, c % 2 == 0, checked, corrupt, corrupt, k % 2 == 0).alias("ocr"), C.event_status(required, eligible, covered).alias("event"),
        C.caption_status(required, eligible, covered + 1, checked, corrupt).alias("caption"),
    )


NAMES = ("Scene-Type", " summary ", "objects", "Place", "celebration", "Attire", "document", "unknown thing", "main activity", "EVENT")
ALIASES = ("Receipt Total", "amount due", "wifi-password", "flight", "Booking ID", "document_email", "mobile", "date", "link", "store", "nothing")
INTENTS = ("COUNT", "SUM", "TIMELINE", "FIND_MEDIA", "UNKNOWN")


@query(f"""SELECT o_orderkey AS id, ['scene', 'scene_summary', 'object', 'setting', 'occasion', 'clothing', 'document_type', NULL, 'primary_activity', 'occasion'][o_orderkey % 10 + 1] AS predicate,
    ['total', 'amount', 'password', 'flight_number', 'order_id', 'email', 'phone', 'date', 'url', 'merchant', NULL][o_orderkey % 11 + 1] AS field,
    ['deterministic_or_estimated_count', 'numeric_sum', 'deterministic_timeline', 'hybrid_media', NULL][o_orderkey % 5 + 1] AS executor FROM orders""")
def registry_lookups(spark, sf_dir) -> DataFrame:
    """Names as a model or a user gives them, brought to the canonical ones."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        k.alias("id"), C.canonical_predicate(_choice(NAMES, k % 10)).alias("predicate"), C.fact_field(_choice(ALIASES, k % 11)).alias("field"), C.executor(_choice(INTENTS, k % 5)).alias("executor")
    )


@query("""WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN to_json({'claims': [{'text': text, 'evidence_ids': [conv_id::VARCHAR, role]}], 'answer': role})::VARCHAR WHEN 1 THEN to_json({'claims': [], 'answer': role, 'extra': 1})::VARCHAR ELSE text END AS answer FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN (SELECT sha256(text) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn = a.turn) END AS claim, CASE WHEN turn % 3 = 0 THEN json_extract_string(answer, '$.answer') END AS answer,
      CASE WHEN turn % 3 = 0 THEN 2 END::INT AS evidence FROM a""")
def decoded_answers(spark, sf_dir) -> DataFrame:
    """Answers as JSON, with an unknown field, and as plain text; only the first kind is taken."""
    t = load(spark, sf_dir, "conversations")
    claims = F.array(F.struct(F.col("text"), F.array(F.col("conv_id").cast("string"), "role").alias("evidence_ids"))).alias("claims")
    good, more = F.to_json(F.struct(claims, F.col("role").alias("answer"))), F.to_json(F.struct(F.slice(claims, 1, 0).alias("claims"), F.col("role").alias("answer"), F.lit(1).alias("extra")))
    made = t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, good).when(F.col("turn") % 3 == 1, more).otherwise(F.col("text")).alias("answer"))
    d = made.select("conv_id", "turn", C.decoded_claims(F.col("answer")).alias("d"))
    return d.select("conv_id", "turn", F.sha2(F.get("d.claims", F.lit(0))["text"], 256).alias("claim"), F.col("d.answer").alias("answer"), F.when(F.col("d").isNotNull(), F.size(F.get("d.claims", F.lit(0))["evidence_ids"])).alias("evidence"))
