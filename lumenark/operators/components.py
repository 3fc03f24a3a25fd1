"""Connected components of an undirected graph of links, and when they became one."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import passing, written


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the folder that the cluster names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenark-"))
    return df.checkpoint()


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), itself included.

    Labels take the least of the neighbours' labels and then jump to the label of their label, so chains shrink by half a
    round; minima are combined before the shuffle, so a hub costs no more than its links.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = checkpointed(new.join(jump, "component").select("id", "old", F.least("component", "root").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
    raise RuntimeError("components did not settle")


def joined_sets(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component, last) of the ids in ``links`` (a, b, number, part): sets that are joined in the order of their numbers.

    ``last`` is the number of the last link that joined two sets which were still apart: the greatest one of a least spanning
    tree. ``part`` tells links of one number apart. In each round every set takes its least link to another one and the trees that come
    of it shrink by pointer jumping to one set each, so that the number of sets halves at least; no set is ever held as a whole.
    """
    with passing(links.sparkSession):
        kept = lambda df: written(df, "sets")  # noqa: E731 (tables, as checkpoints carry constraints along that grow with every round)
        turned = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
        edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("number", "part").alias("w"))
        edges = kept(edges.groupBy("a", "b").agg(F.min("w").alias("w")))
        labels = kept(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"), F.lit(None).cast("long").alias("last")))
        for _ in range(max_rounds):
            if edges.isEmpty():
                last = labels.groupBy("component").agg(F.max("last").alias("last"))
                return written(labels.drop("last").join(last, "component").select("id", "component", "last"), "sets", result=True)
            least = edges.union(turned(edges)).groupBy(F.col("a").alias("id")).agg(F.min(F.struct("w", "b")).alias("x"))
            least = kept(least.select("id", "x.w", F.col("x.b").alias("up")))
            # links have one order, so the only circle is a link that both of its sets take
            other = least.select(F.col("id").alias("up"), F.col("w").alias("_w"))
            tree = kept(least.join(other, "up").select("id", F.when((F.col("w") == F.col("_w")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up")))
            moved = True
            while moved:
                above = tree.select(F.col("id").alias("up"), F.col("up").alias("top"))
                jumped = kept(tree.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
                moved, tree = not jumped.where("moved").isEmpty(), jumped.select("id", "up")
            tops = least.select("id", F.col("w.number").alias("number")).join(tree, "id").groupBy("up").agg(F.max("number").alias("number"))
            root = kept(tree.join(tops, "up").select(F.col("id").alias("component"), "up", "number"))
            labels = kept(labels.join(root, "component", "left").select("id", F.coalesce("up", "component").alias("component"), F.greatest("last", "number").alias("last")))
            ends = [root.select(F.col("component").alias(c), F.col("up").alias(f"_{c}")) for c in ("a", "b")]
            apart = edges.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w")
            edges = kept(apart.groupBy("a", "b").agg(F.min("w").alias("w")))
        raise RuntimeError("sets did not settle")
