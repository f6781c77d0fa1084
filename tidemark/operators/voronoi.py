"""Nearest places by term and vertex, and places whose cells touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.road import both_ways


def nearest_by_term(poi_term: DataFrame, vertex_poi: DataFrame) -> DataFrame:
    """(term, v, p, dist): the nearest place with a term for each vertex, ties by number; a min over structs, so it is
    combined before the shuffle."""
    best = poi_term.join(vertex_poi, "p").groupBy("term", "v").agg(F.min(F.struct("dist", "p")).alias("x"))
    return best.select("term", "v", "x.p", "x.dist")


def adjacency(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, p1, p2), p1 < p2: places with a term of which a road joins the cells."""
    a, b = cells.select("term", F.col("v").alias("a"), F.col("p").alias("x")), cells.select("term", F.col("v").alias("b"), F.col("p").alias("y"))
    rows = both_ways(edges).join(a, "a").join(b, ["term", "b"]).where("x <> y")
    return rows.select("term", F.least("x", "y").alias("p1"), F.greatest("x", "y").alias("p2")).distinct()


def by_leaf(cells: DataFrame, leaves: DataFrame) -> DataFrame:
    """(term, leaf, p): places nearest to some vertex of a leaf."""
    return cells.join(leaves, "v").select("term", "leaf", "p").distinct()
