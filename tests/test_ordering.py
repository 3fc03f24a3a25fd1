"""Running totals against Python, whatever the groups' sizes and ties."""

import random

from pyspark.sql import functions as F

from lumenark.operators.ordering import running_totals
from lumenark.sources.shared import written


def test_totals_of_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", "d", "", None]), rng.choice([None, *range(40)]), rng.randrange(0, 9)) for i in range(3_000)]
    table = written(spark.createDataFrame(rows, "id long, g string, x long, n long").repartition(7), "t")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = running_totals(table, [F.col("x").desc_nulls_last(), F.col("id")], F.col("n"), "g").collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        want, sums = {}, {}
        for i, g, x, n in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
            want[i] = sums.get(g, 0)
            sums[g] = want[i] + n
        assert {r["id"]: r["before"] for r in got} == want and len(got) == len(rows)
        assert got[0].asDict().keys() == {"id", "g", "x", "n", "before"}


def test_ranks_with_equal_rows_and_empty_table(spark):
    table = written(spark.createDataFrame([(1,)] * 500 + [(2,)] * 3, "x long"), "t")
    assert sorted(r["before"] for r in running_totals(table, [F.col("x")]).collect()) == list(range(503))
    assert sorted(r["before"] for r in running_totals(table, [F.col("x")]).where("x = 2").collect()) == [500, 501, 502]
    assert running_totals(written(table.limit(0), "t"), [F.col("x")]).count() == 0
