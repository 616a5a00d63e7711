"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame, send: int = 500_000) -> DataFrame:
    """``(id, label)`` for every id in the links (a, b): label is the smallest id reachable.

    Alternates two steps until nothing changes: every id sends its larger neighbours to its smallest
    neighbour, then its smaller ones.  The number of rows never grows and paths halve, so a chain of n
    links takes about log n rounds.  A hub's links are rows like any others: no group is gathered.  Smallest
    neighbours are sent to the links where those have been counted to be at most ``send``, else joined by shuffle.
    """
    edges = written(_down(links.select("a", "b")), "edges")
    sent = F.broadcast if edges.count() <= send else lambda df: df
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = written(_down(both.where("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(sent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(_down(small.unionByName(least.select("a", F.col("m").alias("b")))), "small")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and that one none: nothing is left to change."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up")))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def _down(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller id, each once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
