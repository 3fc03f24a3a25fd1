"""Coverage and progress counters: one aggregate over each table, whatever the number of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, FAILED = ("PENDING", "RUNNING", "FAILED_RETRYABLE"), ("FAILED_EXHAUSTED", "FAILED_PERMANENT")
#: The mark of a job that another model's job has replaced.
SUPERSEDED = "superseded:"


def number(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))


def people_coverage(items: DataFrame, stages: DataFrame) -> DataFrame:
    """Eligible items (id), those whose faces are indexed, open (no stage counts as open) and failed."""
    s = F.col("status")
    mine = stages.where("stage = 'FACES'").select("id", "status")
    return items.select("id").join(mine, "id", "left").agg(
        F.count("*").alias("eligible"), number(s == "COMPLETE").alias("indexed"), number(s.isNull() | s.isin(*OPEN)).alias("pending"), number(s.isin(*FAILED)).alias("failed"),
    )


def index_summary(items: DataFrame, stages: DataFrame, facts: DataFrame, keyframes: DataFrame, events: DataFrame) -> DataFrame:
    """The counters of an index in one row: items by state, stages by kind, vectors, faces, facts, keyframes and events."""
    state, ready = F.col("index_state"), (F.col("media_kind") == "IMAGE") & (F.col("access_state") == "ACCESSIBLE") & (F.col("index_state") == "READY")
    media = items.agg(
        F.count("*").alias("discovered"), number((F.col("source_kind") == "DEMO_ASSET") | (state == "READY")).alias("ready"), number(F.size("tags") > 0).alias("tagged"),
        number(state.isin("PENDING", "INDEXING")).alias("pending"), number(state.isin("FAILED_RETRYABLE", *FAILED)).alias("failed"), number(ready).alias("face_eligible"),
    )
    done, s, of = F.col("status").isin("COMPLETE", "SKIPPED"), F.col("status"), lambda stage: F.col("stage") == stage
    accessible = F.col("access_state") == "ACCESSIBLE"
    seen = stages.join(items.select("id", "access_state", ready.alias("_ready")), "id", "left").agg(
        number(of("METADATA") & done).alias("metadata_ready"), number(of("OCR") & done).alias("ocr_ready"), number(of("ENRICHMENT") & done).alias("labels_ready"),
        number(of("EMBEDDING") & accessible).alias("vectors_eligible"), number(of("EMBEDDING") & accessible & (s == "COMPLETE")).alias("vectors_ready"),
        number(of("EMBEDDING") & accessible & s.isin(*OPEN)).alias("vectors_pending"), number(of("EMBEDDING") & accessible & s.isin(*FAILED)).alias("vectors_failed"),
        number(of("FACES") & (s == "COMPLETE") & F.col("_ready")).alias("faces_scanned"),
    )
    more = [
        facts.where("scope = 'MEDIA'").agg(F.count_distinct("evidence_media_id").alias("semantic_facts_ready")),
        keyframes.agg(F.count("*").alias("video_keyframes_ready")), events.agg(F.count("*").alias("events")),
    ]
    out = media.crossJoin(F.broadcast(seen))  # a row each, here and below
    for one in more:
        out = out.crossJoin(F.broadcast(one))
    return out


def memory_progress(jobs: DataFrame, eligible: DataFrame, reason: str, facts: DataFrame, captions: DataFrame) -> DataFrame:
    """Jobs (id, media_id, reason, status, model_version) by status, and the distinct eligible items of a reason by state."""
    live = ~F.coalesce("model_version", F.lit("")).startswith(SUPERSEDED)
    s = F.col("status")
    all_jobs = jobs.where(live).agg(F.count("*").alias("jobs"), *[number(s == x).alias(x.lower()) for x in ("PENDING", "RUNNING", "COMPLETE", "FAILED", "AUTH_REQUIRED")])
    mine = jobs.where(live & F.col("reason").startswith(reason)).join(eligible.select(F.col("id").alias("media_id")).distinct(), "media_id", "left_semi")
    distinct = lambda *states: F.count_distinct(F.when(s.isin(*states), F.col("media_id")))
    items = mine.agg(distinct("COMPLETE").alias("items_complete"), distinct("PENDING", "RUNNING").alias("items_open"), distinct("FAILED").alias("items_failed"), distinct("AUTH_REQUIRED").alias("items_auth"))
    counts = facts.agg(F.count("*").alias("facts")).crossJoin(F.broadcast(captions.agg(F.count("*").alias("captions")))).crossJoin(F.broadcast(eligible.agg(F.count_distinct("id").alias("items_eligible"))))
    return all_jobs.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(counts))


def text_integrity(values: DataFrame, valid: Column, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Checked and corrupt items and values of stored texts (media_id, kind, raw_text, normalized_value); ``valid`` judges a ``value``.

    Each stored text counts once for each of its two values.
    """
    some = values.where(F.col("kind").isin(*kinds)) if kinds else values
    each = some.select("media_id", F.explode(F.array("raw_text", "normalized_value")).alias("value"))
    bad = ~F.coalesce(valid, F.lit(False))
    return each.agg(F.count_distinct("media_id").alias("checked_media"), F.count("*").alias("checked_values"), F.count_distinct(F.when(bad, F.col("media_id"))).alias("corrupt_media"), number(bad).alias("corrupt_values"))


def ocr_status(required: Column, eligible: Column, covered: Column, available: Column, checked_media: Column, corrupt_media: Column, corrupt_values: Column, complete: Column) -> Column:
    """Status of the text channel; corrupt texts fail it if all must be whole, or if all are corrupt."""
    return (
        F.when(~required | (eligible == 0), "NOT_REQUIRED").when((corrupt_values > 0) & (complete | (corrupt_media >= checked_media)), "FAILED").when(corrupt_values > 0, "PARTIAL")
        .when(covered >= eligible, "SUCCESS").when(covered > 0, "PARTIAL").when(~available, "UNAVAILABLE").otherwise("PARTIAL")
    )


def event_status(required: Column, eligible: Column, covered: Column) -> Column:
    return F.when(~required, "NOT_REQUIRED").when(covered >= eligible, "SUCCESS").when(covered > 0, "PARTIAL").otherwise("UNAVAILABLE")


def caption_status(required: Column, eligible: Column, captioned: Column, chunks: Column, indexed: Column) -> Column:
    return (
        F.when(~required | (eligible == 0), "NOT_REQUIRED").when(F.greatest(captioned, F.lit(0)) < eligible, "PARTIAL").when(chunks == 0, "PARTIAL").when(indexed < chunks, "PARTIAL").otherwise("SUCCESS")
    )


#: Intents and what executes them.
EXECUTORS = {
    "FIND_MEDIA": "hybrid_media", "LIST": "deterministic_list", "COUNT": "deterministic_or_estimated_count", "ANSWER_FACT": "ocr_fact", "DOCUMENT_QA": "ocr_document_qa",
    "SUM": "numeric_sum", "MIN_MAX": "numeric_min_max", "EVENT_SUMMARY": "event_summary", "TIMELINE": "deterministic_timeline", "COMPARE": "deterministic_compare",
}
#: Fact fields that a question may name, with their aliases, whether they are numbers, and whether they are sensitive.
FIELDS = (
    ("total", "RECEIPT_TOTAL", "document_total", ("total", "receipt_total", "amount_paid"), True, True),
    ("amount", "AMOUNT", "document_amount", ("amount", "line_amount", "item_amount", "amount_due", "amount_charged", "amount_payable"), True, True),
    ("password", "PASSWORD", "document_password", ("password", "wifi_password", "passcode"), False, True),
    ("flight_number", "FLIGHT_NUMBER", "document_flight_number", ("flight", "flight_number"), False, False),
    ("flight_time", "FLIGHT_TIME", "document_flight_time", ("flight_time", "departure_time", "boarding_time"), False, False),
    ("order_id", "ORDER_ID", "document_order_id", ("order", "order_id", "booking_id"), False, True),
    ("email", "EMAIL", "document_email", ("email", "email_address"), False, True),
    ("phone", "PHONE", "document_phone", ("phone", "phone_number", "mobile"), False, True),
    ("date", "DATE", "document_date", ("date",), False, False),
    ("url", "URL", "document_url", ("url", "website", "link"), False, False),
    ("merchant", "MERCHANT", "document_merchant", ("merchant", "store", "restaurant"), False, False),
)
#: Names under which models give a predicate, by the canonical one.
PREDICATES = {
    "scene": ("scene", "scene_type"), "scene_summary": ("scene_summary", "summary"), "activity": ("activity", "activities"), "image_subject": ("image_subject", "subject"),
    "observed_activity": ("observed_activity",), "activity_state": ("activity_state",), "primary_activity": ("primary_activity", "main_activity"),
    "activity_indicator": ("activity_indicator", "activity_evidence"), "object": ("object", "objects"), "setting": ("setting", "place", "location", "environment"),
    "occasion": ("occasion", "event", "celebration"), "possible_occasion": ("possible_occasion", "suggested_occasion"), "occasion_indicator": ("occasion_indicator", "occasion_evidence"),
    "clothing": ("clothing", "attire", "outfit"), "document_type": ("document_type", "document"),
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def executor(intent: Column) -> Column:
    """What executes an intent; null for one that nothing executes."""
    return _looked_up(EXECUTORS, intent)


def fact_field(name: Column) -> Column:
    """The key of the fact field that a name, an alias or a source stands for; null if there is none. Aliases go first."""
    norm = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_")
    known = {x: key for key, _, source, _, _, _ in FIELDS for x in (key, source)} | {a: key for key, _, _, aliases, _, _ in FIELDS for a in aliases}
    return _looked_up(known, norm)


def canonical_predicate(name: Column) -> Column:
    """The canonical name of a predicate; null for one that isn't known. The table is a constant of the expression."""
    norm = F.translate(F.lower(F.trim(name)), "- ", "__")
    return _looked_up({x: k for k, xs in PREDICATES.items() for x in xs}, norm)


CLAIMS = "struct<claims:array<struct<text:string,evidence_ids:array<string>>>,answer:string>"


def decoded_claims(answer: Column, fields: tuple[str, ...] = ("claims", "answer")) -> Column:
    """A model's answer from JSON with a schema; null where it isn't JSON, or has other fields than those known."""
    known = F.size(F.array_except(F.json_object_keys(answer), F.array(*map(F.lit, fields)))) == 0
    return F.when(known, F.from_json(answer, CLAIMS))
