"""Connected groups of a graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.storage import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b): the component's smallest node.

    In each round a node moves to the smallest of itself and its neighbours; then links are drawn between the
    places moved to, and doubled or inner ones fall away, until none is left. The minimum is a combinable
    aggregate, and joins go between written tables, so a node with a third of all links is split by Spark.
    Rounds are written to the shared folder; their number grows with the logarithm of the longest chain.
    """
    edges = written(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    place = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).filter("a != to"))
        # a place moved to may move on itself: follow one more step, so chains halve
        further = first.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moves = written(first.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to")))
        def moved(df, column):
            return df.join(moves.select(F.col("a").alias(column), F.col("to").alias("_to")), column, "left").withColumn(
                column, F.coalesce("_to", column)).drop("_to")
        used = place, edges, moves, first
        place = written(moved(place, "at"))
        edges = written(moved(moved(edges, "a"), "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        dropped(*used)
    dropped(edges)
    out = written(place.withColumnRenamed("at", "component"))
    dropped(place)
    return out
