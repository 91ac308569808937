"""Connected components of an edge table, by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import removed, written


def components(edges: DataFrame, root: str) -> DataFrame:
    """v, c: each vertex of ``edges`` (u, v: bigint) and the smallest vertex of
    its component. No vertex's neighbours are ever gathered: each round takes the
    minimum over them (combined in the map tasks) and then lets labels follow
    their own label. Each round is written below ``root``, which cuts lineage, and
    the round before is deleted.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{root}/edges")
    labels = written(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("c")), f"{root}/labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("n"))
        # a label is a vertex too: take over the label that it has
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("j"))
        new = step.join(jump, "n").select("v", F.least("n", "j").alias("c"), F.col("c").alias("old"))
        new = written(new, f"{root}/labels-{k}")
        removed(new.sparkSession, f"{root}/labels-{k - 1}")
        if new.where("c <> old").isEmpty():
            return new.select("v", "c")
        labels = new.select("v", "c")
