"""Social pull of places: friends who checked in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def friend_checkins(friend: DataFrame, checkin: DataFrame) -> DataFrame:
    """(u, p, n): how many friends of u checked in at p; pairs without any are left out."""
    visits = checkin.select(F.col("u").alias("v"), "p").distinct()
    return friend.distinct().join(visits, "v").groupBy("u", "p").agg(F.count("*").alias("n"))


def friend_places(friend: DataFrame, checkin: DataFrame) -> DataFrame:
    """(u, places, m): one row a user, with the places where friends checked in, each as often as it has friends there, and
    the most friends at one place."""
    visits = checkin.select(F.col("u").alias("v"), "p").repartition("v").groupBy("v").agg(F.collect_set("p").alias("ps"))
    rows = friend.distinct().join(visits, "v").select("u", "ps").repartition("u").groupBy("u").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("places"))
    most = F.expr("aggregate(places, named_struct('p', cast(null as bigint), 'n', 0L, 'm', 0L), (a, p) -> named_struct('p', p, 'n', if(a.p <=> p, a.n, 0L) + 1, 'm', greatest(a.m, if(a.p <=> p, a.n, 0L) + 1)), a -> a.m)")
    return rows.select("u", "places", most.alias("m"))


def most_friends(counts: DataFrame) -> DataFrame:
    """(u, m): the largest number of friends of u at any place."""
    return counts.groupBy("u").agg(F.max("n").alias("m"))


def social_score(counts: DataFrame) -> DataFrame:
    """(u, p, soc): friends at the place over the most at any place."""
    return counts.join(most_friends(counts), "u").select("u", "p", (F.col("n") / F.col("m")).alias("soc"))
