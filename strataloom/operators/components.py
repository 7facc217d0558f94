"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strataloom.session import cut, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Every node points to a smaller node of its component (at first itself). A round looks up the
    pointer of each pointer, takes the smallest one among a node's neighbours, hooks the node and the
    node it points to under it and jumps over one step. Trees get flat by doubling, so even a long chain
    takes a number of rounds about the logarithm of its length, and there is no limit on rounds: pointers
    only fall, so the last round is reached. Each round is three joins by node and two aggregations
    (combined map-side, so a hub costs one row per partition). Its table is written to the shared folder,
    which keeps the plan short and survives a lost executor, and the table before it is deleted; only
    whether a pointer changed reaches the driver. Null ends and loops are ignored; an empty edge table
    gives no rows.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, moved = _written(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"), F.lit(True).alias("moved")))
    while moved:
        above = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = labels.select("node", "up").join(above, "up")
        near = links.join(jumped.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("least"))
        seen = jumped.join(near, "node")
        mine = seen.select("node", F.col("up").alias("old"), F.least("top", "least").alias("new"))
        hooked = seen.select(F.col("up").alias("node"), F.lit(None).cast(links.schema["a"].dataType).alias("old"), F.col("least").alias("new"))
        after = mine.unionByName(hooked).groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("up"))
        before = labels
        labels, moved = _written(after.select("node", "up", (F.col("up") < F.col("old")).alias("moved")))
        release(before)
    return labels.select("node", F.col("up").alias("component"))


def _written(labels: DataFrame) -> tuple[DataFrame, int]:
    """The pointers as a table, and how many of them moved, counted while they were written."""
    seen = Observation()
    return cut(labels.observe(seen, F.count(F.when(F.col("moved"), True)).alias("moved"))), seen.get["moved"]
