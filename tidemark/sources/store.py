"""Stored indexes: everything that queries start from, written once as Parquet and read back by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import road, social, text, voronoi


def build_indexes(domain, path: str) -> None:
    """Write the tables that queries share: terms and weights, social scores, distances, leaves, bounds, nearest places."""
    d = road.apsp(domain.road_vertex, domain.road_edge)
    d.write.parquet(f"{path}/apsp")
    d = domain.spark.read.parquet(f"{path}/apsp")
    leaves = road.partition(domain.road_vertex)
    counts = social.friend_checkins(domain.friend, domain.checkin)
    cells = voronoi.nearest_by_term(domain.poi_term, road.vertex_place(d, domain.pois, "p"))
    tables = {
        "users": domain.users, "pois": domain.pois, "user_term": domain.user_term, "poi_term": domain.poi_term, "checkin": domain.checkin, "friend": domain.friend,
        "term_idf": text.term_idf(domain.poi_term, domain.n_pois), "social": social.social_score(counts), "user_max_social": social.most_friends(counts),
        "leaf": leaves, "ancestor": road.ancestors(leaves), "border": road.borders(leaves, domain.road_edge), "leaf_bounds": road.leaf_bounds(leaves, domain.road_edge, d), "v2p": cells,
    }
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    cells = domain.spark.read.parquet(f"{path}/v2p")
    voronoi.adjacency(cells, domain.road_edge).write.parquet(f"{path}/nvd_adj")
    voronoi.by_leaf(cells, leaves).write.parquet(f"{path}/l2p")


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows of `new` in place of those of `old` with their keys, written to a new path."""
    old.join(new.select(*keys), keys, "left_anti").unionByName(new).write.parquet(path)
    return old.sparkSession.read.parquet(path)


def remove(old: DataFrame, gone: DataFrame, keys: list[str], path: str) -> DataFrame:
    old.join(gone.select(*keys), keys, "left_anti").write.parquet(path)
    return old.sparkSession.read.parquet(path)
