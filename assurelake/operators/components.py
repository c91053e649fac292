"""Connected components by contraction.

Each round every node points to its smallest neighbour if that is smaller than itself; pointers are followed to their
ends by squaring, and the edges between ends are what the next round works on. Groups given as stars are one
point after the first round. Each round's tables are written, so a lost executor costs no more than a read, and
the edges that are left get fewer each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.sources.catalog import written


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, to) with every pointer followed to its end; a node without a pointer is an end."""
    while True:
        on = pointers.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        longer = written(pointers.join(on, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), "pointers")
        pointers = longer.select("node", "to")
        if longer.filter("moved").isEmpty():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it is connected with."""
    left = written(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "edges")
    labels = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        left = left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pointers = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        ends = _ends(written(pointers, "pointers"))
        if ends.isEmpty():
            return labels
        to = ends.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        labels = written(labels.join(to, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_t", "component").alias("component")), "labels")
        for side in ("a", "b"):
            left = left.join(to, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_t", side)).select("a", "b")
        left = written(left.filter("a <> b").distinct(), "edges")
