"""Hard filters over the catalogue, as columns: they reach the scan, and come before any ranking."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of document-like names.
DOCUMENT_WORDS = ("receipt", "invoice", "document", "ticket", "boarding", "menu", "screenshot", "wifi", "confirmation")
#: Words of labels, and of file names beside them, that the recognition gate looks for.
LABEL_WORDS = ("receipt", "invoice", "document", "menu", "ticket", "boarding", "pass", "form", "text", "screen")
NAME_WORDS = (*LABEL_WORDS, "screenshot", "screen_shot", "wifi", "calendar", "confirmation")
#: Fixed value: names of screen captures, on text whose other characters are blanks.
SCREENSHOT = r"\b(?:screenshots?|screen\s+shots?|screen\s+captures?)\b"


def all_of(*conditions: Column) -> Column:
    """AND of the conditions; TRUE of none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def time_range(start_ms: int | None, end_ms: int | None, column: str = "captured_ms") -> Column:
    """Inclusive at both ends; an unknown time is in no range, not even an open one."""
    c = F.col(column)
    out = c.isNotNull()
    if start_ms is not None:
        out &= c >= start_ms
    if end_ms is not None:
        out &= c <= end_ms
    return out


def kind_is(kind: str) -> Column:
    return F.col("kind") == kind


def album_is(album: str) -> Column:
    return F.lower("album") == album.strip().lower()


def joined_identity(*columns: str) -> Column:
    return F.concat_ws(" ", *columns, F.array_join("tags", " "))


def document_like() -> Column:
    return F.lower(joined_identity("filename", "title")).rlike("|".join(DOCUMENT_WORDS))


def media_scope(scope: str) -> Column:
    """ALL, IMAGES, VIDEOS, or DOCUMENTS (PDF, recognised text, or a document-like name)."""
    return {
        "ALL": F.lit(True), "IMAGES": kind_is("IMAGE"), "VIDEOS": kind_is("VIDEO"),
        "DOCUMENTS": kind_is("PDF") | (F.trim("text") != "") | document_like(),
    }[scope]


def at_place(place: str | None) -> Column:
    """The place occurs in location, album, title, file name or a tag."""
    needle = (place or "").strip().lower()
    if not needle:
        return F.lit(True)
    fields = [F.lower(c).contains(needle) for c in ("location", "album", "title", "filename")]
    return reduce(lambda a, b: a | b, fields) | F.exists("tags", lambda t: F.lower(t).contains(needle))


def is_screenshot() -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(" ", "filename", "title", "album", F.array_join("tags", " "))), r"[^\p{L}\p{N}]+", " ").rlike(SCREENSHOT)


def sold_by(items: DataFrame, facts: DataFrame, merchant: str | None) -> DataFrame:
    """Items with a merchant fact that holds the name, or the name in their identity."""
    needle = (merchant or "").strip().lower()
    if not needle:
        return items
    known = facts.where((F.col("entity_type") == "MERCHANT") & (F.lower("raw_text").contains(needle) | F.lower("normalized_value").contains(needle))).select(F.col("media_id").alias("id")).distinct()
    by_fact = items.join(known.withColumn("by_fact", F.lit(True)), "id", "left")
    return by_fact.where(F.col("by_fact") | F.lower(joined_identity("filename", "title")).contains(needle)).drop("by_fact")


@dataclass(frozen=True)
class Scope:
    """What a question may look at, before anything is ranked."""

    media: str = "ALL"
    start_ms: int | None = None
    end_ms: int | None = None
    timed: bool = False
    kind: str | None = None
    album: str | None = None
    place: str | None = None
    screenshots: bool | None = None  # True: only those; False: none of them
    conditions: tuple[Column, ...] = field(default=())

    def column(self) -> Column:
        parts = [media_scope(self.media), at_place(self.place), *self.conditions]
        if self.timed or self.start_ms is not None or self.end_ms is not None:
            parts.append(time_range(self.start_ms, self.end_ms))
        if self.kind:
            parts.append(kind_is(self.kind))
        if self.album:
            parts.append(album_is(self.album))
        if self.screenshots is not None:
            parts.append(is_screenshot() if self.screenshots else ~is_screenshot())
        return all_of(*parts)


def eligible(items: DataFrame, scope: Scope, plan_ids: DataFrame | None = None, explicit_ids: DataFrame | None = None) -> DataFrame:
    """The closed set of items that every channel ranks: filters, then the plan's ids, else the explicit ones, else all."""
    out = items.where(scope.column())
    ids = plan_ids if plan_ids is not None else explicit_ids
    return out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")


def direct_evidence(scope: str = "scope", applicability: str = "applicability") -> Column:
    """Whether evidence is about the item itself rather than its event or group."""
    s, a = F.col(scope), F.coalesce(F.col(applicability), F.lit(""))
    return (
        F.when(a.isin("CONTEXTUAL", "EVENT_CONTEXT_ONLY", "GROUP_CONTEXT_ONLY"), False).when(s.isin("EVENT", "VISUAL_GROUP"), False)
        .when(s == "EXACT_DUPLICATE_GROUP", a.isin("SAFE_FOR_EXACT_DUPLICATES", "EXACT_DUPLICATE_SHARED")).otherwise(F.col("media_id") == F.col("evidence_media_id"))
    )


def evidence_priority() -> Column:
    return F.when(F.col("applicability") == "POSSIBLE_INFERENCE", 3).when(F.col("source_field") == "visual_verification", 0).when(F.col("scope").isin("MEDIA", "QUERY_VERIFICATION"), 1).otherwise(2)


def evidence_allowed(event_intent: bool) -> Column:
    """Admission of evidence: no group context, no unshared duplicates; events only where the question is about one."""
    shared = (F.col("scope") != "EXACT_DUPLICATE_GROUP") | F.col("applicability").eqNullSafe("EXACT_DUPLICATE_SHARED")
    event = (F.col("scope") != "EVENT") & (F.col("source_field") != "event") | F.lit(event_intent)
    return (F.trim(F.col("media_id").cast("string")) != "") & (F.col("scope") != "VISUAL_GROUP") & shared & event


def text_likelihood(edge_density: Column | None = None) -> Column:
    """Score of the recognition gate: file name 4, label 3, screen geometry 1, edges 2; PDFs 100. Recognise from 3."""
    label = F.exists("tags", lambda t: F.lower(t).rlike("|".join(LABEL_WORDS)))
    longer, shorter = F.greatest("width", "height", F.lit(1)), F.greatest(F.least("width", "height"), F.lit(1))
    screen = (longer / shorter).between(1.45, 2.4) & (F.col("width") * F.col("height") >= 700_000)
    score = F.when(F.lower("filename").rlike("|".join(NAME_WORDS)), 4).otherwise(0) + F.when(label, 3).otherwise(0) + F.when(screen, 1).otherwise(0)
    if edge_density is not None:
        score += F.when(edge_density >= 0.16, 2).otherwise(0)
    return F.when(F.col("kind") == "PDF", 100).otherwise(score)
