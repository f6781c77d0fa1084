"""Synthetic data: Zipf-shaped keyword frequencies, subsets, and samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geosocial import draw


def zipf_targets(ranked: DataFrame, n: int, share: float = 0.15) -> DataFrame:
    """(term, rank, df, target): wanted frequency share * n / rank of each ranked term."""
    return ranked.withColumn("target", F.floor(F.lit(share * n) / F.col("rank")).cast("long")).select("term", "rank", "df", "target")


def zipf_deficit(targets: DataFrame) -> DataFrame:
    return targets.select("term", (F.col("target") - F.col("df")).alias("deficit"))


def zipf_rewrite(terms: DataFrame, targets: DataFrame, n_items: int, seed: int = 1) -> DataFrame:
    """(p, term): each term is taken from places, or added to places without it, until it is near its target frequency.

    Places are numbered from 0 to n_items - 1.  Which ones lose a term goes by a hash; new ones are drawn by hash, twice
    as many as needed, and those that have the term already are passed over.
    """
    lot = draw(F.lit("zipf"), F.col("p"), F.col("term"), seed=seed)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(lot, "p"))
    kept = terms.join(targets, "term").withColumn("rn", rank).where("rn <= target").select("p", "term")
    short = targets.where("target > df").select("term", (F.col("target") - F.col("df")).alias("lack"))
    drawn = short.select("term", "lack", F.explode(F.sequence(F.lit(0), 2 * F.col("lack") + 10)).alias("i"))
    drawn = drawn.select("term", "lack", "i", (draw(F.lit("add"), F.col("term"), F.col("i"), seed=seed) % n_items).alias("p")).groupBy("term", "p").agg(F.min("i").alias("i"), F.min("lack").alias("lack"))
    free = drawn.join(terms.select("p", "term"), ["p", "term"], "left_anti")
    added = free.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy("i"))).where("rn <= lack").select("p", "term")
    return kept.unionByName(added)


def zipf_shares(rank_weights: DataFrame, theta: float) -> DataFrame:
    """Cumulated shares of ranks, from which a uniform number picks the first that reaches it."""
    w = F.pow(F.col("rank"), F.lit(-theta))
    total = rank_weights.agg(F.sum(w).alias("z"))
    return rank_weights.crossJoin(total).select("rank", (F.sum(w).over(Window.orderBy("rank")) / F.col("z")).alias("cum"))


def hash_subset(rows: DataFrame, key: str, percent: int, seed: int = 1) -> DataFrame:
    """Rows of which a hash of the key falls into the first percent of a hundred; a smaller subset is part of a larger."""
    return rows.where(draw(F.lit("subset"), F.col(key), seed=seed) % 100 < percent)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return rows.orderBy(draw(F.lit("sample"), F.col(key), seed=seed), key).limit(n)


def hash_pairs(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """(pair, a, b): n pairs of keys by hash."""
    size = rows.count()
    spark = rows.sparkSession
    each = spark.range(n).withColumnRenamed("id", "pair")
    return each.select("pair", (draw(F.lit("a"), F.col("pair"), seed=seed) % size).alias("a"), (draw(F.lit("b"), F.col("pair"), seed=seed) % size).alias("b"))


def distance_buckets(d: DataFrame, n: int) -> DataFrame:
    """(t, bucket): vertices by distance from a centre (t, d) in n buckets of one width; the farthest is in none."""
    top = d.agg(F.max("d").alias("m"))
    return d.crossJoin(top).where("d < m").select("t", F.floor(F.col("d") * n / F.col("m")).cast("long").alias("bucket"))
