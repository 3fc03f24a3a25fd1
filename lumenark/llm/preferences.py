"""Preference formatting: chosen and rejected conversations with their shared beginning rendered once.

The longest common prefix of turns (equal role and text) is the prompt; what follows on either side is a completion. A
turn is rendered as ``<|role|>``, a line break, the text, ``<|end|>`` and a line break; a marker within a text or role is broken up by a
blank, so that no text can pose as a turn. The mask of a completion names the spans (code points within the completion, end
exclusive) that count for the loss: text and end marker of the assistant's turns.

A conversation is one training example, so its turns become one row; conversations are not gathered with each other. Where
there are no rejected conversations, another one with the same opening stands in (``with_other_replies``).

A conversation is read whole, whatever the length of its texts. Defined results: a null text is empty, a null role is ``unknown``; rows without a conversation id are ignored; equal turns with the
same number count once, others with the same number follow each other by role and text, null numbers come first; pairs
whose sides are equal have empty completions; an empty table gives no pairs; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation (conv_id, turn, role, text) in order."""
    plain = turns.where("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return plain.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(n)


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(turn["role"]), F.lit("|>\n"), _safe(turn["text"]), F.lit("<|end|>\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """Spans of the assistant's turns within the rendered turns: array of (start, end)."""
    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(_safe(turn["role"])) + 5
        end = start + F.length(_safe(turn["text"])) + 7
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and masks of ``pairs`` (pair_id, chosen, rejected: arrays of turns)."""
    n = common_prefix(F.col("chosen"), F.col("rejected"))
    cut = pairs.select("pair_id", n.alias("n_prompt_turns"), "chosen", "rejected")
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.size(c))
    prompt = F.slice(F.col("chosen"), F.lit(1), F.col("n_prompt_turns"))
    cut = cut.select("pair_id", "n_prompt_turns", prompt.alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return cut.select(
        "pair_id", "n_prompt_turns", text_of(F.col("p")).alias("prompt"), text_of(F.col("c")).alias("chosen"), mask_of(F.col("c")).alias("chosen_mask"),
        text_of(F.col("r")).alias("rejected"), mask_of(F.col("r")).alias("rejected_mask"),
    )


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the turns of the next one of its range; the last has none."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield _with_next(held, batch.column("turns").slice(0, 1))
            held = batch
    if held is not None:
        yield _with_next(held, pa.nulls(1, held.column("turns").type))


def _with_next(batch: pa.RecordBatch, after: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([batch.column("turns").slice(1), after])], names=[*batch.schema.names, "other"])


def with_next(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, other): each conversation with the turns of the next in one ring over all.

    The ring goes by the digest of the opening (the first turn), then by that of the id: conversations with one opening
    follow each other, so that a conversation and the next share their first turns wherever there is another one. Ranges
    of this order are sorted and passed through once; only the last row of a range looks for the first of the next one.
    """
    opening = F.md5(F.concat_ws("\u001f", F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"]))
    keys = ["opening", "digest", "conv_id"]
    rows = conversations.select("conv_id", "turns", opening.alias("opening"), F.md5(F.col("conv_id").cast("string")).alias("digest"))
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turns", place.alias("place"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("other", ranged.schema["turns"].dataType)])
    ranged = written(ranged.mapInArrow(_followed, schema), "ring")
    # a row a range from here on
    range_of = F.shiftright("place", 33)
    heads = ranged.groupBy(range_of.alias("at")).agg(F.min("place").alias("head"))
    order = Window.orderBy("at")
    heads = heads.select("at", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("place"))
    firsts = ranged.select("place", F.col("turns").alias("first")).join(heads, "place").select(F.col("at"), "first")
    lasts = ranged.where("other is null").withColumn("at", range_of).join(firsts, "at").select("conv_id", "turns", F.col("first").alias("other"))
    return ranged.where("other is not null").select("conv_id", "turns", "other").unionByName(lasts)


def with_other_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: up to its last reply a conversation is chosen, and the next of the ring rejected.

    Every conversation with a reply gives a pair; one that is alone is paired with itself. Those without a reply have
    nothing to learn from and give none.
    """
    is_reply = lambda t: t["role"] == "assistant"
    at = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), is_reply), True).cast("int") + 1
    # behind its last reply a conversation has nothing to learn from
    known = conversations.where(F.exists("turns", is_reply)).select("conv_id", F.slice("turns", F.lit(1), at).alias("turns"))
    return with_next(known).select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.col("other").alias("rejected"))
