"""Deterministic answers over ranked or eligible items, with evidence, coverage and an exactness label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
MONEY = "decimal(38,2)"
SHOWN = 20


def currency(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)(₹|\binr\b|\brs\.?)"), "INR").when(text.rlike(r"(?i)(\busd\b|\$)"), "USD").otherwise("UNSPECIFIED")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, NUMBER, 0), ",", ""), F.lit("")).cast(MONEY)


def best_fact(facts: DataFrame, by: tuple[str, ...] = ("media_id", "entity_type")) -> DataFrame:
    """One fact of each kind for each item: the highest confidence, then the lowest row id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("confidence"), F.asc("fact_id")))
    return facts.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def document_identity(digest: str = "content_digest", media_id: str = "media_id") -> Column:
    """Rows of equal content are one document."""
    given = F.nullif(F.trim(F.col(digest)), F.lit(""))
    return F.coalesce(F.concat(F.lit("digest:"), given), F.concat(F.lit("media:"), F.col(media_id).cast("string")))


def numeric_facts(facts: DataFrame) -> DataFrame:
    """Facts with a number, one of each document: the first of ``position``."""
    once = F.row_number().over(Window.partitionBy("identity").orderBy("position", "media_id"))
    out = facts.withColumn("identity", document_identity()).withColumn("_n", once).where("_n = 1").drop("_n")
    return out.withColumn("value", first_number(F.col("raw_text"))).withColumn("currency", currency(F.col("raw_text"))).where("value is not null")


def total(facts: DataFrame, complete: bool) -> DataFrame:
    """Exact sum of the documents' numbers; refused over several currencies or if not everything was read."""
    out = numeric_facts(facts).agg(F.sum("value").alias("value"), F.count("*").alias("documents"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("currency"))
    refused = (F.col("currencies") > 1) | F.lit(not complete)
    return out.select(
        F.when(~refused, F.col("value")).alias("value"), "documents", F.when(F.col("currencies") == 1, F.col("currency")).alias("currency"),
        F.when(F.lit(not complete), "PARTIAL_COVERAGE").when(F.col("currencies") > 1, "MIXED_CURRENCIES").otherwise("OK").alias("status"),
    )


def extremes(facts: DataFrame) -> DataFrame:
    """Least and greatest number with the document of each; ties go to the first in order."""
    n = numeric_facts(facts)
    first = F.struct("position", "media_id")
    return n.agg(
        F.min("value").alias("min_value"), F.min_by("media_id", F.struct(F.col("value"), first)).alias("min_id"),
        F.max("value").alias("max_value"), F.max_by("media_id", F.struct(F.col("value"), F.negative("position"), F.negative("media_id"))).alias("max_id"), F.count("*").alias("documents"),
    )


def distinct_list(items: DataFrame, key: Column, shown: int = SHOWN) -> DataFrame:
    """Distinct values with their number: in the order first seen, ``shown`` of them."""
    values = items.select(key.alias("value"), "position").where("value is not null and trim(value) <> ''").groupBy("value").agg(F.min("position").alias("first_at"), F.count("*").alias("items"))
    count = values.agg(F.count("*").alias("distinct_values"))
    return values.orderBy("first_at", "value").limit(shown).crossJoin(F.broadcast(count))  # one row


def timeline(items: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Items a capture date, oldest first."""
    day = F.to_date(F.timestamp_millis("captured_ms"))
    return items.where("captured_ms is not null").groupBy(day.cast("string").alias("day")).agg(F.count("*").alias("items")).orderBy("day").limit(shown)


def compare_groups(items: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The largest groups with their number of items and time span; the first seen of equal ones."""
    out = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("items"), F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms"), F.min("position").alias("_at"))
    return out.orderBy(F.desc("items"), "_at").limit(n).drop("_at")


def compare_scopes(items: DataFrame, scopes: list[str], fields: tuple[str, ...] = ("location", "album", "title", "filename", "description"), events: DataFrame | None = None) -> DataFrame:
    """Asked scopes in their order, the first two that have items; an item may be in several.

    With ``events`` (event_id, title, location, search_text) an item is also in the scopes that its event (``event_id``) names; a
    scope is looked for once in an event, whatever its number of items.
    """
    named = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("scope")) for i, s in enumerate(scopes)])
    holding = lambda text: F.filter(named, lambda s: text.contains(F.lower(F.trim(s["scope"]))))
    own = holding(F.lower(F.concat_ws("\u001f", *fields, F.array_join("tags", "\u001f"))))
    if events is not None:
        theirs = events.select("event_id", holding(F.lower(F.concat_ws("\u001f", "title", "location", "search_text"))).alias("_theirs"))
        items = items.join(theirs, "event_id", "left")
        own = F.array_union(own, F.coalesce("_theirs", F.array().cast("array<struct<place:int,scope:string>>")))
    hits = items.select("id", "captured_ms", F.explode(own).alias("s"))
    out = hits.groupBy("s.place", "s.scope").agg(F.count_distinct("id").alias("items"), F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms"))
    return out.orderBy("place").limit(2).drop("place")


def event_summary(items: DataFrame, people: DataFrame) -> DataFrame:
    """Span, up to four places, reviewed people (distinct without case, sorted), four representatives of a set of items."""
    place = items.where("trim(location) <> ''").groupBy("location").agg(F.min("position").alias("at")).orderBy("at", "location").limit(4).agg(F.sort_array(F.collect_list(F.struct("at", "location"))).alias("p"))
    names = people.join(items.select("id"), "id", "left_semi").groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name")).agg(F.sort_array(F.collect_set("name")).alias("people"))
    shown = items.orderBy("position").limit(4).agg(F.sort_array(F.collect_list(F.struct("position", "id"))).alias("r"))
    span = items.agg(F.count("*").alias("items"), F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms"))
    one = span.crossJoin(F.broadcast(place)).crossJoin(F.broadcast(names)).crossJoin(F.broadcast(shown))  # a row each
    return one.select("items", "first_ms", "last_ms", F.col("p.location").alias("places"), "people", F.col("r.id").alias("representatives"))


def document_fact(hits: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """The first document in order, and of it the first fact in the order of the fields: an older one may not stand in."""
    first = hits.orderBy("position", "id").limit(1).select(F.col("id").alias("media_id"))
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("entity_type"))
    found = best_fact(facts.where(F.col("entity_type").isin(fields))).join(F.broadcast(first), "media_id").withColumn("_o", order)
    return found.orderBy("_o").limit(1).drop("_o")


def document_details(hits: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """The best fact of each field over the documents, in the order of the fields."""
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("entity_type"))
    mine = facts.where(F.col("entity_type").isin(fields)).join(hits.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return best_fact(mine, ("entity_type",)).withColumn("place", order)


def exactness(all_indexed: Column, deterministic: Column, semantic_status: Column, verified: Column, complete_scan: Column, access_complete: Column) -> Column:
    """How far an answer may be trusted; the order of the rules matters."""
    return (
        F.when(~all_indexed | ~access_complete, "PARTIAL_INDEX").when(verified, "ESTIMATED_FROM_RETRIEVAL")
        .when(complete_scan & (semantic_status == "SUCCESS"), "COMPLETE_PREDICATE_SCAN").when(deterministic, "EXACT")
        .when(semantic_status.isin("UNAVAILABLE", "FAILED", "PARTIAL"), "PARTIAL_INDEX").otherwise("ESTIMATED_FROM_RETRIEVAL")
    )


def count_answer(verified: Column, metadata: Column, scan: Column, ranked: Column) -> Column:
    """The first known of: verified matches, exact metadata, a complete scan, the ranked list."""
    return F.coalesce(verified, metadata, scan, ranked)


def stage_coverage(items: DataFrame, stages: DataFrame, stage: str) -> DataFrame:
    """Eligible, covered (complete or skipped), failed and open items of a stage, and whether it is complete."""
    mine = stages.where(F.col("stage") == stage).select("id", "status")
    s = F.coalesce("status", F.lit("PENDING"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = items.select("id").join(mine, "id", "left").agg(F.count("*").alias("eligible"), n(s.isin("COMPLETE", "SKIPPED")).alias("covered"), n(s.startswith("FAILED")).alias("failed"), n(s.isin("PENDING", "RUNNING")).alias("pending"))
    return out.withColumn("complete", F.col("covered") >= F.col("eligible"))


def coverage_matrix(stages: DataFrame, names: list[str], statuses: list[str]) -> DataFrame:
    """Counts of every stage and status, zero where there is none: the domain is a few constants."""
    spark = stages.sparkSession
    domain = spark.createDataFrame([(a, b) for a in names for b in statuses], "stage string, status string")
    return F.broadcast(domain).join(stages.groupBy("stage", "status").agg(F.count("*").alias("n")), ["stage", "status"], "left").select("stage", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def channel_status(required: Column, eligible: Column, covered: Column) -> Column:
    return F.when(~required | (eligible == 0), "NOT_REQUIRED").when(covered >= eligible, "SUCCESS").when(covered > 0, "PARTIAL").otherwise("UNAVAILABLE")


def pipeline_state(enabled: Column, paused: Column, unavailable: Column, foreground: Column, running: Column, pending: Column, failed: Column, admitted: Column, enqueued: Column, attempts: Column) -> Column:
    """State of a background pipeline by ordered rules."""
    return (
        F.when(~enabled, "STOPPED_BY_USER").when(paused & (pending > 0), "PAUSED_BY_USER").when(unavailable, "UNAVAILABLE").when(foreground & (pending > 0), "RUNNING").when(running, "RUNNING")
        .when((pending == 0) & (failed > 0), "DEGRADED").when(pending == 0, "COMPLETE").when(~admitted, "WAITING_CONSTRAINTS").when(enqueued & (attempts > 0), "BACKOFF")
        .when(enqueued, "WAITING_CONSTRAINTS").otherwise("FAILED")
    )


def access_coverage(required: Column, granted: Column, total_: Column) -> Column:
    return F.when(~required, "NOT_REQUIRED").when(granted >= total_, "COMPLETE").when(granted > 0, "PARTIAL").otherwise("UNAVAILABLE")


def progress(processed: Column, remaining: Column, elapsed_ms: Column) -> tuple[Column, Column]:
    """Items a minute, and milliseconds to go; null before anything is done."""
    rate = F.when((processed > 0) & (elapsed_ms > 0), processed * 60000.0 / elapsed_ms)
    return rate, F.when(rate > 0, F.ceil(remaining * 60000.0 / rate))


def frequently_retrieved(members: DataFrame, n: int) -> DataFrame:
    """The n items that most result sets hold (id, times), from a row for each item of each set."""
    return members.groupBy("id").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "id").limit(n)


def shelves(items: DataFrame) -> DataFrame:
    """Items by the day of their capture and by shelf: the album, else the place, else ``Other``; those without a time are on none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    day, shelf = F.to_date(F.timestamp_millis("captured_ms")).cast("string"), F.coalesce(blank("album"), blank("location"), F.lit("Other"))
    return items.where("captured_ms is not null").groupBy(day.alias("day"), shelf.alias("shelf")).agg(F.count("*").alias("items"))
