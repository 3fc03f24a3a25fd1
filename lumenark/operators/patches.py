"""Patches of follow-up questions: what a session's plan is after all of them, for every session at once.

A patch belongs to a result set (session_id, set_id, parent_id, created_ms) and has operations (type, field, value): ADD and REPLACE set a
field, REMOVE takes it away. It applies only if its parent is the session's latest set when it comes; others are stale and
change nothing. So the sets that apply are a chain: the first without a parent, then of each set's children the first that
comes after it. How far a set is along the chain is found by pointer jumping, in as many rounds as the logarithm of the
longest chain; a field's value is that of the last set along it. No session is gathered or walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

# What a patch may do, and to what.
TYPES = ("ADD", "REPLACE", "REMOVE")
FIELDS = ("INTENT", "TIME", "MEDIA_KIND", "FILTER", "PEOPLE", "PLACE", "SEMANTIC_CLAUSES", "OCR", "SORT", "GROUPING", "AGGREGATION", "VERIFICATION", "ANSWER_MODE", "LIMIT", "SCOPE")
MOST_FIELDS = 16


def chained(patches: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``patches`` with ``depth``, their place in their session's chain from 0; null for stale ones."""
    sets = checkpointed(patches.select("session_id", "set_id", "parent_id", "created_ms").distinct())
    when = F.struct("created_ms", "set_id")
    first = sets.where("parent_id is null").groupBy("session_id").agg(F.min(when)["set_id"].alias("child")).withColumn("parent", F.lit(None).cast(sets.schema["set_id"].dataType))
    parents = sets.select("session_id", F.col("set_id").alias("parent_id"), F.col("created_ms").alias("before"))
    later = sets.join(parents, ["session_id", "parent_id"]).where("created_ms > before or created_ms = before and set_id > parent_id")
    next_ = later.groupBy("session_id", F.col("parent_id").alias("parent")).agg(F.min(when)["set_id"].alias("child"))
    links = first.select("session_id", "parent", "child").unionByName(next_.select("session_id", "parent", "child"))
    # a pointer to a set further back, how far that is, and whether its end is known: depth is from the first set on
    state = checkpointed(links.select("session_id", F.col("child").alias("set_id"), F.col("parent").alias("back"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps")))
    for _ in range(max_rounds):
        if state.where("back is not null").isEmpty():
            break
        ahead = state.select("session_id", F.col("set_id").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        moved = state.where("back is not null").join(ahead, ["session_id", "back"]).select("session_id", "set_id", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"))
        state = checkpointed(state.where("back is null").unionByName(moved))  # children of stale sets find no set and go
    return patches.join(state.select("session_id", "set_id", F.col("steps").alias("depth")), ["session_id", "set_id"], "left")


def _checked(operations: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("not a patch: "), F.coalesce("type", F.lit("null")), F.lit(" "), F.coalesce("field", F.lit("null"))))
    return operations.withColumn("type", F.when(F.col("type").isin(*TYPES) & F.col("field").isin(*FIELDS), F.col("type")).otherwise(wrong))


def active_plans(patches: DataFrame) -> DataFrame:
    """(session_id, field, value, set_id): the fields of each session's plan after its last set, and the set that each comes from.

    ``patches`` have the columns of the sets and ``operations``, of which a field may be in one only and at most ``MOST_FIELDS``; an
    unknown type or field is an error.
    """
    n = F.size("operations")
    wrong = F.raise_error(F.lit("a patch must change 1 to 16 fields, each once"))
    fields = F.transform("operations", lambda o: o["field"])
    sound = patches.withColumn("operations", F.when(n.between(1, MOST_FIELDS) & (F.size(F.array_distinct(fields)) == n), F.col("operations")).otherwise(wrong))
    rows = _checked(chained(sound).where("depth is not null").select("session_id", "set_id", "depth", F.explode("operations").alias("o")).select("session_id", "set_id", "depth", "o.*"))
    last = rows.groupBy("session_id", "field").agg(F.max_by(F.struct("type", "value", "set_id"), "depth").alias("x"))
    return last.where("x.type <> 'REMOVE'").select("session_id", "field", F.col("x.value").alias("value"), F.col("x.set_id").alias("set_id"))
