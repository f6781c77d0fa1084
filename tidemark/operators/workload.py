"""Query workloads: candidate places by term and check-ins, keyword pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pois_of_terms(poi_term: DataFrame, terms: list, n: int, checkin: DataFrame | None = None, pool: int = 200) -> DataFrame:
    """First n places, by number, with any of the terms; with checkin given, of those nobody has visited."""
    rows = poi_term.where(F.col("term").isin(terms)).select("p").distinct()
    if checkin is not None:
        rows = rows.join(checkin.select("p"), "p", "left_anti")
    return rows.orderBy("p").limit(min(n, pool))


def keyword_pool(posting: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """Terms whose document frequency lies strictly between two limits, the first by name."""
    return posting.where((F.col("df") > low) & (F.col("df") < high)).select("term", "df").orderBy("term").limit(most)


def candidate_groups(topk: DataFrame) -> DataFrame:
    """(p, n): how many users have each place among their best."""
    return topk.groupBy("p").agg(F.count("*").alias("n"))
