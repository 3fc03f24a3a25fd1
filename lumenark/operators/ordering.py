"""Running totals in an order over a whole table, or over groups of any size, without a task that gets a whole group.

The rows are dealt by ranges of the group and the order, sorted in each range, and summed from the start of the range; what
a range takes over from those before it is one number, as only its first group can have begun earlier. These numbers are
as many as there are ranges. Ranges are cut at rows, so a group that holds a third of a table is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

_GROUP, _AMOUNT, _ROW, _PART, _NUMBER, _HERE = "lk_group", "lk_amount", "lk_row", "lk_part", "lk_number", "lk_here"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the range, the number of the group within it, and the sum of the group's earlier amounts in it."""
    part = TaskContext.get().partitionId()
    last, number, total = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = pa.concat_arrays([last if last is not None else batch.column(_GROUP).slice(0, 1), batch.column(_GROUP)])
        a, b = group.slice(0, n), group.slice(1)
        begins = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        amount = batch.column(_AMOUNT).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = number + np.cumsum(begins)
        sums = np.cumsum(amount) + total  # as if all belonged to the group that is open
        base = np.zeros(n, np.int64)
        heads = np.flatnonzero(begins)
        base[heads] = sums[heads] - amount[heads]
        base = np.maximum.accumulate(base)  # amounts are not negative
        here = sums - base
        last, number, total = group.slice(n), int(numbers[-1]), int(here[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(numbers), pa.array(here - amount)], names=[*batch.schema.names, _PART, _NUMBER, _HERE])


def running_totals(table: DataFrame, order: Sequence[Column], amount: Column | None = None, group: str | None = None) -> DataFrame:
    """``table`` with ``before``: the sum of ``amount`` (not negative; 1 by default) over earlier rows of the same group.

    ``table`` should be one that was written, as its rows are read twice. Rows that are equal in ``order`` come in any
    order, one after the other. Groups are told apart with null as a value of its own.
    """
    own = table.columns
    rows = table.select("*", (F.col(group) if group else F.lit(0)).alias(_GROUP), F.coalesce(amount if amount is not None else F.lit(1), F.lit(0)).cast("long").alias(_AMOUNT), F.monotonically_increasing_id().alias(_ROW))
    keys = [F.col(_GROUP).asc_nulls_last(), *order, F.col(_ROW)]
    schema = T.StructType([*rows.schema.fields, T.StructField(_PART, T.LongType()), T.StructField(_NUMBER, T.LongType()), T.StructField(_HERE, T.LongType())])
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_summed, schema), "ranges")
    upto = F.col(_HERE) + F.col(_AMOUNT)
    ends = ranged.groupBy(_PART).agg(
        F.min(F.struct(_NUMBER, _GROUP))[_GROUP].alias("first"), F.max(F.struct(F.col(_NUMBER), upto.alias("total"), F.col(_GROUP))).alias("last"),
    )
    carried, open_group, open_total = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r[_PART]):  # a row for each range
        goes_on = open_group is not None and open_group == (r["first"],)
        carried.append((r[_PART], open_total if goes_on else 0))
        open_total = r["last"]["total"] + (carried[-1][1] if r["last"][_NUMBER] == 0 else 0)
        open_group = (r["last"][_GROUP],)
    offsets = table.sparkSession.createDataFrame(carried, f"{_PART} long, lk_carried long")
    before = F.col(_HERE) + F.when(F.col(_NUMBER) == 0, F.col("lk_carried")).otherwise(0)
    return ranged.join(F.broadcast(offsets), _PART).select(*own, before.alias("before"))
