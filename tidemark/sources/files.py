"""Domain tables of a folder of text files, for the same queries as those derived from the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.sources import text


class TextDomain:
    """Roads, users, places, friendships and check-ins of `<folder>/<name>.cnode`, `.cedge`, `.user`, `.poi`, `.friendship`
    and `.checkin`; the places asked for stand in `.query`, one number a line, or are the first five where it is absent.

    Parallel roads count with the shortest, loops and negative lengths go, and users and places are put on the graph that is
    left.  Terms are numbers.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "graph", k: int = 20):
        self.spark, self.stem, self.k = spark, f"{folder.rstrip('/')}/{name}", k

    @cached_property
    def road_vertex(self) -> DataFrame:
        return text.read_vertices(self.spark, f"{self.stem}.cnode")

    @cached_property
    def road_edge(self) -> DataFrame:
        raw = text.read_edges(self.spark, f"{self.stem}.cedge")
        one = clean.dedup_undirected(raw)
        return one.join(raw.groupBy("ni", "nj").agg(F.min("eid").alias("eid")), ["ni", "nj"]).select("eid", "ni", "nj", "dist")

    @cached_property
    def _n_vertices(self) -> int:
        return (self.road_vertex.agg(F.max("v")).first()[0] or -1) + 1

    def _places(self, kind: str, key: str) -> DataFrame:
        return text.read_places(self.spark, f"{self.stem}.{kind}", key)

    def _placed(self, kind: str, key: str) -> DataFrame:
        return text.on_graph(self._places(kind, key).drop("terms"), self.road_edge, self._n_vertices)

    @cached_property
    def users(self) -> DataFrame:
        return self._placed("user", "u")

    @cached_property
    def pois(self) -> DataFrame:
        return self._placed("poi", "p")

    @cached_property
    def user_term(self) -> DataFrame:
        return text.inverted_index(self._places("user", "u"), "u").select("u", "term")

    @cached_property
    def poi_term(self) -> DataFrame:
        return text.inverted_index(self._places("poi", "p"), "p").select("p", "term")

    @cached_property
    def friend(self) -> DataFrame:
        return text.read_friends(self.spark, f"{self.stem}.friendship").where("u <> v").distinct()

    @cached_property
    def friend_und(self) -> DataFrame:
        return self.friend.unionByName(self.friend.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()

    @cached_property
    def checkin(self) -> DataFrame:
        return text.read_checkins(self.spark, f"{self.stem}.checkin").groupBy("p", "u").agg(F.sum("cnt").alias("cnt"))

    @cached_property
    def n_users(self) -> int:
        return (self._places("user", "u").agg(F.max("u")).first()[0] or -1) + 1

    @cached_property
    def n_pois(self) -> int:
        return self._places("poi", "p").count()

    @cached_property
    def query_poi(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.stem}.query")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return text.read_ids(self.spark, f"{self.stem}.query")
        return self.pois.select("p").orderBy("p").limit(5)
