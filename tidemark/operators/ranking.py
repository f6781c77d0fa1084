"""Scored pairs, each user's best places, and the users that have a place among their best (reverse top-k)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geosocial import ALPHA, BASE, gsk_score, influence, lower_score, upper_score
from tidemark.operators.best import Best, above
from tidemark.operators.road import nearest, with_distance
from tidemark.operators.social import friend_checkins, social_score
from tidemark.operators.text import relevance, term_idf
from tidemark.plans.cuts import cut


class Scores:
    """The score of every pair with relevance, from domain tables; distances d from road.apsp() or road.sssp(), or an index of
    border_index(), which makes those of occurring pairs only."""

    def __init__(self, domain, distances: DataFrame, a: float = BASE, alpha: float = ALPHA):
        self.domain, self.d, self.a, self.alpha = domain, distances, a, alpha

    def relevant(self) -> DataFrame:
        t = self.domain
        return relevance(t.user_term, t.poi_term, term_idf(t.poi_term, t.n_pois))

    def edges_in_reach(self) -> DataFrame:
        """(u_ni, u_nj, p_ni, p_nj) of edges with a user and a place that share a term: from terms by edge, not from pairs."""
        t = self.domain
        us = t.user_term.join(t.users.select("u", F.col("ni").alias("u_ni"), F.col("nj").alias("u_nj")), "u").select("term", "u_ni", "u_nj").distinct()
        ps = t.poi_term.join(t.pois.select("p", F.col("ni").alias("p_ni"), F.col("nj").alias("p_nj")), "p").select("term", "p_ni", "p_nj").distinct()
        return us.join(ps, "term").drop("term").distinct()

    def scored(self, pairs: DataFrame | None = None) -> DataFrame:
        """(u, p, rel, inf, dist, score); scores are rounded to nine places, so that ties do not depend on the order in
        which weights were summed."""
        t = self.domain
        soc = social_score(friend_checkins(t.friend, t.checkin))
        rows = (self.relevant() if pairs is None else pairs).join(soc, ["u", "p"], "left").select("u", "p", "rel", influence(F.coalesce("soc", F.lit(0.0)), self.a, self.alpha).alias("inf"))
        rows = with_distance(rows, t.users, t.pois, self.d, ends=None if pairs is not None else self.edges_in_reach())
        return rows.withColumn("score", F.round(gsk_score(F.col("rel"), F.col("inf"), F.col("dist"), self.alpha), 9))


def user_topk(scored: DataFrame, k: int) -> DataFrame:
    """(u, p, score, rank): the k best places of each user, ties by place."""
    return nearest(scored.select("u", "p", "score"), ["u"], [F.desc("score"), F.asc("p")], k)


def user_kth(scored: DataFrame, k: int) -> DataFrame:
    """(u, rk): the k-th best score of users with that many places."""
    return user_topk(scored, k).where(F.col("rank") == k).select("u", F.col("score").alias("rk"))


def reverse_topk(scored: DataFrame, pois: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """(p, u, rel, inf, dist, score, rk) of the users who score a place of `pois` above their own k-th best (at least as
    high with strict=False).  One pass serves all places: each user's best k are ranked once."""
    asked = pois.select("p", F.lit(True).alias("asked")).distinct()
    rows = scored.join(asked, "p", "left").withColumn("asked", F.col("asked").isNotNull())
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), F.asc("p")))
    bound = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("u"))  # the pairs are made once for both
    rows = rows.withColumn("rank", rank).where((F.col("rank") <= k) | F.col("asked")).withColumn("rk", F.coalesce(bound, F.lit(0.0))).where("asked")
    keep = F.col("score") > F.col("rk") if strict else F.col("score") >= F.col("rk")
    return rows.where(keep).select("p", "u", "rel", "inf", "dist", "score", "rk")


class ByPairs:
    """What Best gives, from all pairs: for domains that do not fit it."""

    def __init__(self, scores: Scores, k: int, users: DataFrame | None = None):
        rows = scores.scored(None if users is None else scores.relevant().join(users, "u", "left_semi"))
        self.scored, self.k = rows, k

    def topk(self) -> DataFrame:
        return user_topk(self.scored, self.k)

    def kth(self) -> DataFrame:
        return user_kth(self.scored, self.k)

    def reverse(self, pois: DataFrame, strict: bool = True) -> DataFrame:
        return reverse_topk(self.scored, pois, self.k, strict)


def best_places(scores: Scores, k: int, users: DataFrame | None = None) -> Best | ByPairs:
    """Each user's k best places: topk(), kth() and reverse() are user_topk(), user_kth() and reverse_topk() of all scored
    pairs, which are only made where there are too many spots or terms for classes of users."""
    best = Best(scores, k, users)
    return best if best.fits else ByPairs(scores, k, users)


def all_pairs(scores: Scores, digits: int = 6) -> DataFrame:
    """Scores.scored() rounded to `digits` places, by kinds of places where the domain has few enough spots and terms."""
    best = Best(scores, 1)
    if best.fits:
        return best.pairs(digits)
    return scores.scored().select("u", "p", *(F.round(c, digits).alias(c) for c in ("rel", "inf", "dist", "score")))


def reverse_keywords(scores: Scores, words: DataFrame, k: int, places: DataFrame | None = None) -> DataFrame:
    """As reverse_topk(), for places with keywords (p, term) given instead of their own; users' k-th best scores are those of
    the places that are there.

    places: (p, ni, nj, dist, dis) of places that the domain does not have, such as a bare location; nobody has checked in
    there, so their influence is one.
    """
    best = Best(scores, k)
    if best.fits:
        return best.reverse(words, words=words, places=places)
    t = scores.domain
    rel = relevance(t.user_term, words, term_idf(t.poi_term, t.n_pois))
    if places is None:
        rows = scores.scored(rel)
    else:
        rows = with_distance(rel.withColumn("inf", F.lit(1.0)), t.users, places, scores.d)
        rows = rows.withColumn("score", F.round(gsk_score(F.col("rel"), F.col("inf"), F.col("dist"), scores.alpha), 9))
    return above(rows, user_kth(scores.scored(), k))


def reverse_topk_bound(scores: Scores, pois: DataFrame, k: int, bounds: DataFrame, best: Best | ByPairs | None = None) -> DataFrame:
    """As reverse_topk(), but exact scores are made for candidates only.

    bounds: (u, p, rel, dmin, dmax).  A user's k-th best lower score bounds what a place must reach; users for whom no
    place of `pois` can reach it by its upper score are never scored.  With a Best given, the k-th best of each user's
    class is that bound, and bounds of `pois` suffice.
    """
    if isinstance(best, Best):
        floor = best.floors()
    else:
        low = bounds.select("u", "p", lower_score(F.col("rel"), F.col("dmax"), scores.alpha).alias("score"))
        floor = user_kth(low, k).withColumnRenamed("rk", "floor")
    asked = bounds.join(pois.select("p"), "p", "left_semi")
    top = asked.withColumn("top", upper_score(F.col("rel"), F.col("dmin"), scores.a, scores.alpha))
    users = top.join(floor, "u", "left").where(F.col("top") + 1e-8 >= F.coalesce("floor", F.lit(0.0))).select("u").distinct()
    if isinstance(best, Best):
        return best.reverse(pois, users=cut(users, "candidates"))  # it is read more than once
    return reverse_topk(scores.scored(scores.relevant().join(users, "u", "left_semi")), pois, k)


def per_term_topk(rows: DataFrame, k: int) -> DataFrame:
    """(v, term, rk): the k-th best lower score of each vertex and term, against which a border's terms are cut."""
    w = Window.partitionBy("v", "term").orderBy(F.desc("score"), "p")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("v", "term", F.col("score").alias("rk"))
