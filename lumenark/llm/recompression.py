"""Recompression in Spark rounds: runs and pairs of symbols get names that are global, by tables of what they stand for.

Words get numbers first. A round then names every distinct run (symbol, length) and every distinct pair of neighbours
whose bits are 0 and 1, by a running number over the table of those, and joins the names back to where they occur. Equal
stretches get equal symbols but for a few words at their ends, in whichever documents they are.

``substring_dedup`` takes names from hashes instead, in the task that reads the text, as the rounds here move each symbol
several times (the README has the measured figures). The test holds names to one expansion each, and equal
stretches to one parse inside.

Defined results: null and empty texts have no symbols; rows that repeat an id are told apart by ``row``; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .kernels import NOT_SPACE, blocks, slice_hashes, word_bounds
from .shared import written
from .substring_dedup import RUN_CAPS

SYMBOLS = "row long, at long, symbol long, span long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(0)):
            starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
            n = np.diff(first)
            rows = np.repeat(number + np.arange(hi - lo), n)
            at = np.arange(len(starts)) - np.repeat(first[:-1], n)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(at), pa.array(slice_hashes(buf, starts, ends).view(np.int64)), pa.array(np.ones(len(starts), np.int64))], names=["row", "at", "symbol", "span"])
            number += hi - lo


def _named(occurrences: DataFrame, keys: list[str], first: int) -> DataFrame:
    """The distinct values of the keys with ``name``, numbers from ``first`` on."""
    distinct = written(occurrences.select(*keys).distinct(), "distinct")
    return running_totals(distinct, [F.col(k) for k in keys]).withColumn("name", F.col("before") + first).drop("before")


def _bit(symbol: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(symbol, F.lit(number)), F.lit(2))


def compressed(symbols: DataFrame, number: int, cap: int, free: int) -> tuple[DataFrame, int]:
    """A round: ``symbols`` (row, at, symbol, span) after naming runs of up to ``cap`` words and then pairs, and the next free name."""
    order = Window.partitionBy("row").orderBy("at")
    begins = F.coalesce(F.col("symbol") != F.lag("symbol").over(order), F.lit(True)).cast("long")
    runs = symbols.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("row", "run")
    runs = written(runs.withColumns({"n": F.count("*").over(whole), "total": F.sum("span").over(whole)}).drop("run"), "runs")
    folds = (F.col("n") > 1) & (F.col("total") <= cap)
    heads = runs.where(folds & (F.col("begins") == 1))
    names = _named(heads, ["symbol", "n"], free)
    free += names.count()
    folded = heads.join(names, ["symbol", "n"]).select("row", "at", F.col("name").alias("symbol"), F.col("total").alias("span"))
    symbols = written(runs.where(~folds).select("row", "at", "symbol", "span").unionByName(folded), "folded")
    bit, after = _bit(F.col("symbol"), number), F.lead("symbol").over(order)
    pairs = symbols.withColumns({"bit": bit, "next": after, "next_span": F.lead("span").over(order)})
    opens = (F.col("bit") == 0) & F.col("next").isNotNull() & (_bit(F.col("next"), number) == 1)
    pairs = pairs.withColumn("opens", opens)
    pairs = written(pairs.withColumn("closes", F.coalesce(F.lag("opens").over(order), F.lit(False))).drop("bit"), "pairs")
    firsts = pairs.where("opens")
    names = _named(firsts, ["symbol", "next"], free)
    free += names.count()
    merged = firsts.join(names, ["symbol", "next"]).select("row", "at", F.col("name").alias("symbol"), (F.col("span") + F.col("next_span")).alias("span"))
    return written(pairs.where("not opens and not closes").select("row", "at", "symbol", "span").unionByName(merged), "symbols"), free


def parsed(texts: DataFrame, rounds: tuple[int, ...] = RUN_CAPS) -> DataFrame:
    """(row, at, symbol, span): the symbols of each of ``texts`` (text) after all rounds; rows are numbered as they are read."""
    words = written(texts.select("text").mapInArrow(_words, SYMBOLS), "words")
    names = _named(words, ["symbol"], 0)
    free = names.count()
    symbols = written(words.join(names, "symbol").select("row", "at", F.col("name").alias("symbol"), "span"), "numbered")
    for number, cap in enumerate(rounds):
        symbols, free = compressed(symbols, number, cap, free)
    return symbols
