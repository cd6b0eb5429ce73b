"""Connected components of a table of edges, and joins to a unique key that may be hot on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import fresh, stored

#: Keys that hold at least one row in HOT are looked up by broadcast: there are HOT of them at most.
HOT = 1000


def lookup(rows: DataFrame, keys: list[str], unique: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with `unique`, which has one row for each key. Both sides are stored tables. Keys with many rows are joined by
    broadcast of their few rows of `unique`, so that no task gets all rows of a key; the rest is left to the join by shuffle."""
    n = rows.count()
    hot = rows.groupBy(*keys).count().filter(F.col("count") >= max(n // HOT, 1000)).select(*keys)
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(unique, keys, how)
    mark = fresh(rows, "hot")[0]
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, "left")
    few = unique.join(F.broadcast(hot), keys, "left_semi")
    many = marked.filter(F.col(mark)).drop(mark).join(F.broadcast(few), keys, how)
    return many.unionByName(marked.filter(F.col(mark).isNull()).drop(mark).join(unique, keys, how))


def components(edges: DataFrame) -> DataFrame:
    """node -> root, the least node of its connected component, for every node of the edges (a, b; stored). Every round takes the
    least label among neighbours, then the label of that label, until nothing changes."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "components-labels")
    while True:
        near = lookup(both, ["b"], labels.select(F.col("node").alias("b"), "root")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = stored(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("to")), "components-step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        now = stored(lookup(step, ["to"], jump).select("node", "old", F.least("to", "next").alias("root")), "components-labels")
        labels = now.select("node", "root")
        if now.filter("old <> root").isEmpty():
            return labels
