"""Near-duplicate collapse and order-dependent selections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hamming
from .components import checkpointed, components

HASH_BITS, MAX_DISTANCE, BURST_MS, FRAME_DISTANCE = 64, 6, 15_000, 8


def duplicate_links(items: DataFrame) -> DataFrame:
    """Links (a < b) between items (id, kind, text, phash, captured_ms) that show the same.

    Same kind and same normalised text, and an equal hash, or at most 6 differing bits within 15 s. Seven bands of the
    hash are blocks: of two hashes at a distance of 6, one band is equal. Items of an equal hash are linked with the
    least of them, not with each other; times are in blocks of 15 s that are compared with the next one.
    """
    text = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))  # compared by digest
    known = items.where("phash is not null").select("id", "kind", text.alias("text"), "phash", "captured_ms")
    least = known.groupBy("kind", "text", "phash").agg(F.min("id").alias("a"))
    equal = known.join(least, ["kind", "text", "phash"]).where("a < id").select("a", F.col("id").alias("b"))
    width = HASH_BITS // (MAX_DISTANCE + 1) + 1
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", i * width).bitwiseAND((1 << width) - 1).alias("v")) for i in range(MAX_DISTANCE + 1)])
    slot = F.floor(F.col("captured_ms") / BURST_MS)
    timed = known.where("captured_ms is not null").select("*", F.explode(bands).alias("band"))
    left = timed.select(F.col("id").alias("a"), "kind", "text", "band", F.col("phash").alias("x"), F.col("captured_ms").alias("t"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    right = timed.select(F.col("id").alias("b"), "kind", "text", "band", F.col("phash").alias("y"), F.col("captured_ms").alias("u"), slot.alias("slot"))
    near = left.join(right, ["kind", "text", "band", "slot"]).where((F.abs(F.col("t") - F.col("u")) <= BURST_MS) & (F.col("x") != F.col("y")) & (hamming(F.col("x"), F.col("y")) <= MAX_DISTANCE))
    return equal.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def class_links(known: DataFrame) -> DataFrame:
    """Links (a < b) between classes of rows (t, phash, cls, captured_ms): hashes of one text that differ little, near in time.

    A class is at hand in a slot of 15 s with its first and its last time alone: within a slot all times are near, and of
    two neighbouring slots the last of one and the first of the other are the nearest. So the rows of a class do not
    multiply, however many they are.
    """
    slot = F.floor(F.col("captured_ms") / BURST_MS).alias("slot")
    seen = known.where("captured_ms is not null").groupBy("t", "phash", "cls", slot).agg(F.min("captured_ms").alias("low"), F.max("captured_ms").alias("high"))
    width = HASH_BITS // (MAX_DISTANCE + 1) + 1
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", i * width).bitwiseAND((1 << width) - 1).alias("v")) for i in range(MAX_DISTANCE + 1)])
    banded = seen.select("*", F.explode(bands).alias("band"))
    left = banded.select("t", "band", F.col("cls").alias("a"), F.col("phash").alias("x"), F.col("slot").alias("at"), F.col("high").alias("until"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    right = banded.select("t", "band", "slot", F.col("cls").alias("b"), F.col("phash").alias("y"), F.col("low").alias("since"))
    near = left.join(right, ["t", "band", "slot"]).where((F.col("x") != F.col("y")) & ((F.col("at") == F.col("slot")) | (F.col("since") - F.col("until") <= BURST_MS)) & (hamming(F.col("x"), F.col("y")) <= MAX_DISTANCE))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def collapse(items: DataFrame) -> DataFrame:
    """Items with their ``component``: the least id of what shows the same (see ``duplicate_links``), transitively.

    Items of one kind, text and hash are a class, known by its least id; texts are compared by digest, and components are
    found among classes.
    """
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keyed = items.withColumn("_t", F.when(F.col("phash").isNotNull(), F.md5(F.concat("kind", F.lit("\u001f"), text))))
    known = checkpointed(keyed.where("_t is not null").select("id", F.col("_t").alias("t"), "phash", "captured_ms"))
    classes = checkpointed(known.groupBy("t", "phash").agg(F.min("id").alias("cls")))
    links = class_links(known.groupBy("t", "phash", "captured_ms").agg(F.count("*").alias("n")).join(classes, ["t", "phash"]))
    found = classes.join(components(classes.select(F.col("cls").alias("id")), links).withColumnRenamed("id", "cls"), "cls").select(F.col("t").alias("_t"), F.col("phash").alias("_phash"), "component")
    out = keyed.join(found, (F.col("phash") == F.col("_phash")) & (keyed["_t"] == found["_t"]), "left").drop("_t", "_phash")
    return out.withColumn("component", F.coalesce("component", "id"))


def representatives(items: DataFrame) -> DataFrame:
    """Of each component the best (component, id, rank, members): quality, then pixels, then the earlier rank, then the id.

    Who belongs to a component is the ``component`` of the items; their ids are counted here, not gathered in a row.
    """
    best = F.max_by("id", F.struct(F.coalesce("quality", F.lit(0.0)), "pixels", F.negative("rank"), F.negative("id")))
    return items.groupBy("component").agg(best.alias("id"), F.min("rank").alias("rank"), F.count("*").alias("members"))


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    kept, last = [], None
    for row in pdf.sort_values("at_ms").itertuples():
        if last is None or (int(row.phash) ^ last).bit_count() >= FRAME_DISTANCE:
            kept.append(row.Index)
            last = int(row.phash)
    return pdf.loc[kept]


def thinned_frames(frames: DataFrame) -> DataFrame:
    """Frames (media_id, at_ms, phash) of a clip (12 at most) that differ from the last kept one."""
    return frames.groupBy("media_id").applyInPandas(_thin, frames.schema)


def pick_diverse(pdf: pd.DataFrame, most: int) -> list[int]:
    """Positions of a greedy choice: the best quality, then 0.35 quality and 0.65 least distance to those chosen."""
    q = pdf.quality.fillna(0.0).to_numpy(float)
    order = np.argsort(pdf.id.to_numpy(), kind="stable")
    if len(pdf) <= most:
        return sorted(range(len(pdf)), key=lambda i: (-q[i], pdf.id.iloc[i]))
    h, t = pdf.phash.fillna(0).to_numpy(np.int64), pdf.captured_ms.fillna(0).to_numpy(float)
    faces, text, frame, unknown = pdf.faces.to_numpy(float), pdf.has_text.to_numpy(bool), pdf.frame.to_numpy(float), pdf.phash.isna().to_numpy()
    chosen = [int(order[np.argmax(q[order])])]
    least = np.full(len(pdf), np.inf)
    while len(chosen) < most:
        c = chosen[-1]
        bits = np.array([int(x).bit_count() for x in (h ^ h[c]).astype(np.uint64)]) / 64
        apart = (
            0.35 * np.where(unknown | unknown[c], 0.5, bits) + 0.2 * np.minimum(1, np.abs(t - t[c]) / 86_400_000) + 0.15 * np.minimum(1, np.abs(faces - faces[c]) / 4)
            + 0.15 * (text != text[c]) + 0.15 * np.minimum(1, np.abs(frame - frame[c]))
        )
        least = np.minimum(least, apart)
        value = 0.35 * q + 0.65 * least
        value[chosen] = -np.inf
        chosen.append(int(order[np.argmax(value[order])]))
    return chosen


def selected_diverse(items: DataFrame, group: str, most: int) -> DataFrame:
    """The choice of each group, with its place: that of ``pick_diverse`` over all rows of the group.

    A group can be of any size, so it is not gathered: each of ``most`` rounds is an aggregate with partial maxima over
    all rows, which are joined with the few chosen before, one row a group. Null faces and frames are 0, a null
    has_text is false; equal values go to the lesser id.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = ["q", "phash", "t", "faces", "has_text", "frame", "row"]
    rows = checkpointed(items.select(
        group, F.col("id").cast("long").alias("id"), zero("quality").alias("q"), F.col("phash").cast("long").alias("phash"), zero("captured_ms").alias("t"), zero("faces").alias("faces"),
        F.coalesce("has_text", F.lit(False)).alias("has_text"), zero("frame").alias("frame"), F.monotonically_increasing_id().alias("row"),
    ).withColumnRenamed(group, "grp"))

    def apart(c: Column) -> Column:
        bits = F.when(F.col("phash").isNull() | c["phash"].isNull(), 0.5).otherwise(hamming(F.col("phash"), c["phash"]) / 64)
        near = lambda name, most_of: F.least(F.lit(1.0), F.abs(F.col(name) - c[name]) / most_of)
        other = (F.col("has_text") != c["has_text"]).cast("double")
        return 0.35 * bits + 0.2 * near("t", 86_400_000) + 0.15 * near("faces", 4) + 0.15 * other + 0.15 * near("frame", 1)

    def best(value: Column) -> Column:
        return F.max_by(F.struct("id", *own), F.when(value.isNotNull(), F.struct(value, F.bitwise_not("id"), F.bitwise_not("row"))))

    chosen = rows.groupBy("grp").agg(F.count("*").alias("n"), F.array(best(F.col("q"))).alias("picks"))
    for _ in range(1, most):
        rest = rows.join(chosen.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).drop("of")
        value = F.when(F.col("n") <= most, F.col("q")).otherwise(0.35 * F.col("q") + 0.65 * F.array_min(F.transform("picks", apart)))
        free = F.when(~F.array_contains(F.col("picks.row"), F.col("row")), value)
        chosen = rest.groupBy("grp").agg(F.first("n").alias("n"), F.first("picks").alias("picks"), best(free).alias("pick"))
        chosen = chosen.select("grp", "n", F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("pick"))).alias("picks"))
    return chosen.select(F.col("grp").alias(group), F.posexplode("picks").alias("place", "pick")).select(group, F.col("pick.id").alias("id"), "place")
