"""Connected components of a link table, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.joins import shuffled
from framewright.llm.lineage import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links``; a component is named by its smallest node.

    Each round every node takes its smallest neighbour (or itself) and then that one's, and links are
    drawn between the nodes so taken; links inside what has come together are gone, so the table
    shrinks from round to round until none is left. From the third round on (long chains) nodes follow
    what they took to its end, by doubling, so rounds grow with the logarithm of the number of nodes. Minima are taken before each shuffle, so a node
    with very many neighbours costs one row for each task. Links with a null end and links of a node
    to itself are left out. No table of nodes or links is broadcast.
    """
    links = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(links.distinct())
    labels, rounds = None, 0
    while True:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("p"))
        taken = cut(near.join(shuffled(near.select(F.col("node").alias("p"), F.col("p").alias("label"))), "p").select("node", "label"))
        while rounds > 2:
            far = taken.select(F.col("node").alias("label"), F.col("label").alias("far"))
            moved = cut(taken.join(shuffled(far), "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")))
            taken = moved.select("node", "label")
            if moved.filter("old <> label").isEmpty():
                break
        if labels is None:
            labels = taken
        else:
            now = taken.select(F.col("node").alias("label"), F.col("label").alias("now"))
            labels = cut(labels.join(shuffled(now), "label", "left").select("node", F.coalesce("now", "label").alias("label")))
        x = taken.select(F.col("node").alias("u"), F.col("label").alias("x"))
        y = taken.select(F.col("node").alias("v"), F.col("label").alias("y"))
        drawn = edges.join(shuffled(x), "u").join(shuffled(y), "v").filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        edges = cut(drawn.distinct())
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
