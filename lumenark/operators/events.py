"""Events: sessionization of captures, corrections, attributes, and search over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.ids import signless_long
from .components import checkpointed, joined_sets

HOUR = 3_600_000
LONG_GAP, ALBUM_GAP, MOVE_GAP, MOVE_KM = 18 * HOUR, 45 * 60_000, 30 * 60_000, 100.0
#: Words that make an event a trip.
TRIP_WORDS = ("travel", "trip", "singapore", "goa", "boarding", "hotel")
#: Words of file names that say nothing.
STOP_TOKENS = ("img", "image", "photo", "photos", "picture", "legacy", "demo", "synthetic")
SEARCH_CHARS = 8000


def splits(gap: Column, album: Column, before_album: Column, km: Column) -> Column:
    """Whether a capture starts a new event, from the one before it alone."""
    a, b = F.trim(album), F.trim(before_album)
    changed = (a != "") & (b != "") & (F.lower(a) != F.lower(b))
    return (gap > LONG_GAP) | (gap > ALBUM_GAP) & changed | (gap > MOVE_GAP) & F.coalesce(km > MOVE_KM, F.lit(False))


def sessionize(captures: DataFrame, by: Sequence[str] = ("user_id",), bucket_ms: int = 24 * HOUR) -> DataFrame:
    """Captures with ``session``, the number of their event for each owner; those without a time belong to none.

    A split depends on the capture before it alone, so an owner is cut into buckets of time: windows run within a bucket,
    and what a bucket needs of those before it, the last capture and the number of events, comes from a row a bucket. An owner
    of any size is thus spread over tasks; the captures themselves are shuffled once.
    """
    keys = [*by, "_bucket"]
    known = captures.where("captured_ms is not null").withColumn("_bucket", F.floor(F.col("captured_ms") / bucket_ms))
    w, buckets = Window.partitionBy(*keys).orderBy("captured_ms", "id"), Window.partitionBy(*by).orderBy("_bucket")
    here = F.struct("captured_ms", "id", "album", "latitude", "longitude")

    def joined(rows: DataFrame, a_bucket: DataFrame) -> DataFrame:
        side = a_bucket.toDF(*[f"_{c}" if c in by else f"{c}_of" if c == "_bucket" else c for c in a_bucket.columns])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_bucket") == F.col("_bucket_of")]
        return rows.join(side, on).drop(*[f"_{c}" for c in by], "_bucket_of")

    ends = known.groupBy(*keys).agg(F.max_by(here, F.struct("captured_ms", "id")).alias("_end"))
    before = ends.select(*keys, F.lag("_end").over(buckets).alias("_before"))
    rows = joined(known.withColumn("_prev", F.lag(here).over(w)), before).withColumn("_prev", F.coalesce("_prev", "_before"))
    km = haversine_km(F.col("_prev.latitude"), F.col("_prev.longitude"), F.col("latitude"), F.col("longitude"))
    new = F.coalesce(splits(F.col("captured_ms") - F.col("_prev.captured_ms"), F.col("album"), F.col("_prev.album"), km), F.lit(True))
    rows = rows.withColumn("_new", new.cast("long"))
    counts = rows.groupBy(*keys).agg(F.sum("_new").alias("_n"))
    offset = counts.select(*keys, F.coalesce(F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined(rows.withColumn("_inside", inside), offset).withColumn("session", F.col("_offset") + F.col("_inside")).select(*captures.columns, "session")


def _grouped(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    return sessions.withColumn("grp", F.concat_ws(":", *[F.col(c).cast("string") for c in by], F.col("session").cast("string")))


#: Columns of a table of corrections; numbers tell their order.
CORRECTION = "number long, operation string, ids array<long>, label string"
OPERATIONS = ("MERGE", "SPLIT", "RENAME", "LOCATION")


def correction_table(spark: SparkSession, corrections: Sequence[tuple]) -> DataFrame:
    """(operation, ids) or (operation, ids, label), in the order of their making, as a table."""
    return spark.createDataFrame([(n, op, list(ids), more[0] if more else None) for n, (op, ids, *more) in enumerate(corrections)], CORRECTION)


def _known(corrections: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("unknown correction "), F.coalesce("operation", F.lit("null"))))
    return corrections.withColumn("operation", F.when(F.col("operation").isin(*OPERATIONS), F.col("operation")).otherwise(wrong))


def corrected(sessions: DataFrame, corrections: DataFrame | Sequence[tuple], by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Sessions after MERGE and SPLIT corrections in the order of their numbers, with ``grp``, the key of a group.

    ``corrections`` is a table (number, operation, ids, label) or a list for ``correction_table``; RENAME and LOCATION leave the groups
    as they are and are applied by ``compiled``; any other operation is an error; ids that no session has change nothing.
    Merges of one number are one merge, and come before splits of that number.

    Nothing is replayed step by step. An id stands in its first group until a split names it, then in the set of the last
    split that did, so a merge links the sets in which its ids stand at its number. Sets are never parted, only left: what comes
    of them are the components of these links, each named by the last merge that joined two sets, or by its only set. The plan is
    the same for any number of corrections, and corrections that are all linked are no more in one task than others.
    """
    grouped = _grouped(sessions, by)
    if not isinstance(corrections, DataFrame):
        corrections = correction_table(sessions.sparkSession, corrections)
    known = _known(corrections).where("operation in ('MERGE', 'SPLIT') and number is not null")
    steps = known.select("number", (F.col("operation") == "SPLIT").alias("split"), F.explode(F.array_distinct("ids")).alias("id"))
    own = lambda number: F.concat(F.lit("split-"), number.cast("string"))
    before = F.last(F.when(F.col("split"), F.col("number")), ignorenulls=True).over(Window.partitionBy("id").orderBy("number", "split").rowsBetween(Window.unboundedPreceding, 0))
    stands = steps.join(grouped.select("id", "grp"), "id").select("number", "split", F.coalesce(own(before), "grp").alias("at"))
    merges = stands.where("not split").select("number", "at").distinct()
    order = Window.partitionBy("number").orderBy("at")
    links = merges.select(F.first("at").over(order).alias("a"), F.col("at").alias("b"), "number", F.row_number().over(order).alias("part")).where("part > 1")
    sets = joined_sets(links).where("last is not null").select(F.col("id").alias("_at"), "last")
    parted = steps.where("split").groupBy("id").agg(F.max("number").alias("_split"))
    out = grouped.join(parted, "id", "left").withColumn("_at", F.coalesce(own(F.col("_split")), "grp")).join(sets, "_at", "left")
    return out.withColumn("grp", F.coalesce(F.concat(F.lit("merge-"), F.col("last").cast("string")), "_at")).select(*grouped.columns)


def _labels(groups: DataFrame, corrections: DataFrame) -> DataFrame:
    """Groups that corrections touch: the last title and place of those whose ids are all members, and whether any applies."""
    once = _known(corrections).select(F.col("number").alias("n"), F.col("operation").alias("op"), F.array_distinct("ids").alias("ids"), "label")
    known = once.select("n", "op", F.size("ids").alias("wanted"), "label", F.explode("ids").alias("id"))
    hits = groups.select("grp", "id").join(known, "id").groupBy("grp", "n", "op", "wanted", "label").agg(F.count_distinct("id").alias("have"))
    whole = F.col("op").isin("RENAME", "LOCATION") & (F.col("have") == F.col("wanted"))
    last = lambda op: F.max_by(F.when(whole & (F.col("op") == op), F.col("label")), F.when(whole & (F.col("op") == op), F.col("n")))
    return hits.groupBy("grp").agg(last("RENAME").alias("new_title"), last("LOCATION").alias("new_place"), F.bool_or(whole | F.col("op").isin("MERGE", "SPLIT")).alias("touched"))


def _file_titles(members: DataFrame) -> DataFrame:
    """Up to three words that most file names of a group share, in the order in which they are first seen."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    words = F.filter(F.split(stem, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^(?:v[0-9]+|[0-9]+)$"))
    each = members.select("grp", "captured_ms", "id", F.posexplode(words).alias("at", "word")).withColumn("low", F.lower("word"))
    first = F.min(F.struct("captured_ms", "id", "at", "word")).alias("first")
    counted = each.groupBy("grp", "low").agg(F.count("*").alias("n"), first).join(members.groupBy("grp").agg(F.count("*").alias("members")), "grp")
    least = F.when(F.col("members") <= 2, 1).otherwise(F.greatest(F.lit(2), F.floor((F.col("members") + 1) / 2)))
    some = counted.where((F.col("n") >= least) & ~F.col("low").isin(*STOP_TOKENS))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("first"))).where("place <= 3")
    initial = F.concat(F.upper(F.substring("first.word", 1, 1)), F.expr("substring(first.word, 2)"))
    return some.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", initial.alias("w")))), lambda x: x["w"]), " ").alias("file_title"))


def _member_texts(members: DataFrame) -> DataFrame:
    """The words about the members of a group in the order of capture; members beyond ``SEARCH_CHARS`` add nothing and are left out."""
    parts = ["filename", "title", "album", "location", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), "description"]
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"\s+", " "))
    order = Window.partitionBy("grp").orderBy("captured_ms", "id")
    sized = members.select("grp", "captured_ms", "id", F.substring(text, 1, SEARCH_CHARS).alias("text")).where("text <> ''")
    sized = sized.withColumn("before", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(f"coalesce(before, 0) <= {SEARCH_CHARS}")
    return sized.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("captured_ms", "id", "text"))), lambda x: x["text"]), " ").alias("words"))


def event_ids(members: DataFrame) -> DataFrame:
    """(grp, event_id): the first 8 bytes of the digest of the sorted ids.

    The digest is over one string of all ids, as the format demands: about 20 bytes a member, so that an event of a million
    members is a row of 20 MB.
    """
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\u001f"), 256)
    return members.groupBy("grp").agg(signless_long(digest).alias("event_id"))


def compiled(members: DataFrame, corrections: DataFrame | Sequence[tuple] = ()) -> DataFrame:
    """A row an event from its members (grp, id, captured_ms, latitude, longitude, quality, filename, title, album, location, tags, description, kind).

    The title is a correction's, else the most frequent place, else words that most file names share, else a constant. The
    search text holds title, place and what is known of the members, up to 8,000 characters; the type is read from it.
    Confidence is 1 where a user has corrected, else 0.92, 0.82, 0.72 or 0.58.
    """
    members = checkpointed(members)  # it is read once for each part of an event
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    place = F.trim("location")
    known = members.where((place != "") & ~F.lower("location").isin("unknown", "unknown location"))
    places = known.groupBy("grp", place.alias("p")).agg(F.count("*").alias("n")).groupBy("grp").agg(F.min_by("p", F.struct(F.negative("n"), "p")).alias("place"))
    out = members.groupBy("grp").agg(
        F.min("captured_ms").alias("start_ms"), F.max("captured_ms").alias("end_ms"), F.count("*").alias("members"), F.avg(F.when(has, F.col("latitude"))).alias("latitude"), F.avg(F.when(has, F.col("longitude"))).alias("longitude"),
        F.count_distinct(F.nullif(F.trim(F.lower("album")), F.lit(""))).alias("albums"), F.max_by("id", F.struct(F.coalesce("quality", F.lit(0.0)), "captured_ms", "id")).alias("representative"), F.bool_or(F.col("kind") == "PDF").alias("papers"),
    )
    out = out.join(places, "grp", "left").join(_file_titles(members), "grp", "left").join(_member_texts(members), "grp", "left")
    if not isinstance(corrections, DataFrame) and corrections:
        corrections = correction_table(members.sparkSession, corrections)
    labels = _labels(members, corrections) if isinstance(corrections, DataFrame) else None
    out = out.join(labels, "grp", "left") if labels is not None else out.withColumns({"new_title": F.lit(None).cast("string"), "new_place": F.lit(None).cast("string"), "touched": F.lit(False)})
    alone, touched = F.col("albums") <= 1, F.coalesce("touched", F.lit(False))
    confidence = F.when(touched, 1.0).when((F.col("members") >= 2) & alone & F.col("latitude").isNotNull(), 0.92).when((F.col("members") >= 2) & alone, 0.82).when(F.col("members") >= 2, 0.72).otherwise(0.58)
    title, where = F.coalesce("new_title", "place", F.nullif("file_title", F.lit("")), F.lit("Gallery memory")), F.coalesce("new_place", "place")
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", title, where, "words")), r"\s+", " "))
    out = out.withColumns({"event_title": title, "event_place": where, "search_text": F.substring(text, 1, SEARCH_CHARS), "confidence": confidence, "corrected": touched})
    kind = F.when(F.col("search_text").rlike("|".join(TRIP_WORDS)), "TRIP").when(F.col("papers"), "DOCUMENT_SET").when(F.col("members") == 1, "MOMENT").otherwise("MEMORY")
    return out.select("grp", "start_ms", "end_ms", "members", "latitude", "longitude", F.col("event_title").alias("title"), F.col("event_place").alias("location"), "confidence", "corrected", kind.alias("event_type"), "search_text", "representative")


def search(events: DataFrame, terms: Sequence[str], title: str = "title", text: str = "search_text") -> DataFrame:
    """Share of the terms that occur in title or text, and 0.25 if all are in the title; latest first among equals."""
    body, head = F.lower(F.concat_ws(" ", title, text)), F.lower(F.col(title))
    n = sum((body.contains(t).cast("int") for t in terms), F.lit(0))
    full = sum((head.contains(t).cast("int") for t in terms), F.lit(0)) == len(terms)
    return events.withColumn("score", n / float(len(terms)) + F.when(full, 0.25).otherwise(0.0)).where(n > 0)


def expanded(event_items: DataFrame, predicate_items: DataFrame, contextual: bool) -> DataFrame:
    """Items of matched events: all of them where the question is about events, else those another predicate has too."""
    return event_items if contextual else event_items.join(predicate_items.select("id").distinct(), "id", "left_semi")


def keyframe_times(duration: Column) -> Column:
    """Midpoints of the parts of a clip: one for 5 s up to 30 s (6 at most), else 12."""
    parts = F.when(duration <= 30_000, F.least(F.greatest(F.ceil(duration / 5000.0), F.lit(1)), F.lit(6))).otherwise(12).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.floor((i + 0.5) * duration / parts).cast("long"))


def bursts(items: DataFrame, bucket_ms: int = 30 * 60_000) -> DataFrame:
    """Groups of more than one item of a place within a fixed half hour."""
    key = (F.lower("location").alias("place"), F.floor(F.col("captured_ms") / bucket_ms).alias("bucket"))
    return items.where("captured_ms is not null").groupBy(*key).agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")


def exact_groups(items: DataFrame, digest: str = "digest") -> DataFrame:
    return items.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("members > 1")
