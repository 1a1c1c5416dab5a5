"""Connected components of a link table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, saved, scratch


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (a, b), where root is the smallest node reachable.

    In a round every node moves to its smallest neighbour, if that is smaller;
    links between nodes that moved to one place vanish, the others go on between
    the places, made distinct. Labels only fall, so the rounds end, and the
    smallest node of a component never moves. Joins and map-side aggregates
    only: a node with a third of all links is one skewed key of a join, never a
    collected list. Each round is written, so a lost executor costs one round.
    """
    spark = links.sparkSession
    kept: list[str] = []
    with scratch(spark, kept):
        edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = None
    while True:
        fresh: list[str] = []
        with scratch(spark, fresh):
            near = edges.select(F.col("a").alias("node"), F.col("a").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
            moves = saved(near.groupBy("node").agg(F.min("to").alias("to")))
            if labels is None:
                labels = moves.withColumnRenamed("to", "root")
            else:
                labels = saved(labels.join(moves.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            first = edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            both = first.join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            edges = saved(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        done = not edges.limit(1).count()
        drop(spark, kept)
        kept = fresh
        if done:
            return labels
