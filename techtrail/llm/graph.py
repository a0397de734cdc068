"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import stash, stashed
from techtrail.sources.shared import remove_path


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def _least(edges: DataFrame) -> DataFrame:
    """a, m: the smallest neighbour of each node. As a table it lets Spark split the rows of a node with very many neighbours when it is joined back, or broadcast it if it is small."""
    return stash(edges.groupBy("a").agg(F.min("b").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for edges (a, b) of whole numbers; loops are left out.

    Large and small stars in turn: each node's larger neighbours are linked to its smallest neighbour, then its
    smaller ones are; stars remain, after about the logarithm of the largest component's size. No
    neighbourhood is gathered anywhere: minima are aggregated before they are joined back. The tables of a round are deleted when the next one's is written.
    """
    spark = edges.sparkSession
    with stashed() as made:
        now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        mark, before = _mark(now), None
        while mark != before:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
            large = stash(large)
            lowest = _least(large)
            small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = stash(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
            for path in made[:-1]:
                remove_path(spark, path)
            del made[:-1]
            before, mark = mark, _mark(now)
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
