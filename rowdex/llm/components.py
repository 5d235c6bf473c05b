"""Connected components of a table of links, by contraction.

In each round every vertex takes its smallest neighbour as parent if that is
smaller, parents are followed twice, and links are rewritten between the
vertices that are left. Rounds end when no link joins two of them; a round at
least halves the vertices that still have a link. All steps are joins and
aggregations with partial sums; a vertex with very many links only splits a
join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdex.llm._common import staged


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Gives v and component (the smallest reachable vertex)
    for each vertex that has a link to another one."""
    edges = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        hook = staged(hook, "hooks")
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("v", F.col("pp").alias("p"))
        hook = staged(hook, "hooks")
        if labels is None:
            labels = hook.select("v", F.col("p").alias("component"))
        else:
            step = hook.select(F.col("v").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        labels = staged(labels, "labels")
        for end in ("a", "b"):
            edges = edges.join(hook.select(F.col("v").alias(end), F.col("p").alias("__p")), end).drop(end).withColumnRenamed("__p", end)
        edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
