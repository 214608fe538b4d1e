"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import saved


def roots_of(parents: DataFrame) -> DataFrame:
    """(x, root) for a table (x, parent) in which every parent is smaller than its x.

    Pointers jump over each other until none moves; a chain halves with every round.
    """
    now = saved(parents.select("x", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("x").alias("root"), F.col("root").alias("next"))
        now = saved(
            now.join(up, "root", "left").select(
                "x",
                F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "roots",
        )
        if now.where("moved").isEmpty():
            return now.select("x", "root")
        now = now.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(x, root): the smallest vertex of the component of every vertex of links (a, b).

    Each round hooks every vertex to its smallest neighbour, if that is smaller, jumps to the
    roots of the trees that arise, and goes on with the links between different roots.
    """
    labels: DataFrame | None = None
    rest = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    while True:
        if labels is not None and rest.isEmpty():
            return labels
        # Every link names its larger end first, so hooking goes down and ends.
        trees = roots_of(rest.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("parent")))
        ends = rest.select(F.col("b").alias("x")).join(trees, "x", "left_anti").distinct()
        trees = saved(trees.unionByName(ends.withColumn("root", F.col("x"))), "trees")
        if labels is None:
            labels = trees
        else:
            step = trees.select(F.col("x").alias("root"), F.col("root").alias("next"))
            labels = saved(
                labels.join(step, "root", "left").select("x", F.coalesce("next", "root").alias("root")),
                "labels",
            )
        to_a = trees.select(F.col("x").alias("a"), F.col("root").alias("ra"))
        to_b = trees.select(F.col("x").alias("b"), F.col("root").alias("rb"))
        rest = saved(
            rest.join(to_a, "a")
            .join(to_b, "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
