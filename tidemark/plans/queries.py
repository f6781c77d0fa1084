"""Named queries over the driver's tables; each takes (spark, sf_dir) and has DuckDB SQL in oracles.py where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geosocial import BASE, edge_ends, edge_key, lower_score, morton, point_rect, upper_score
from tidemark.operators.border_index import BorderIndex, border_index
from tidemark.operators import clean, diffusion, ranking, road, selection, social, synth, text, voronoi, workload
from tidemark.plans.cuts import cut
from tidemark.sources.fixtures import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROUNDS, BUDGET, GRAPHS = 16, 5, 200


def query(f: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Domain(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def six(*names: str) -> list:
    """Columns; those with a mark behind them rounded to six places, as sums of doubles depend on their order."""
    return [F.round(n[:-1], 6).alias(n[:-1]) if n.endswith("~") else F.col(n) for n in names]


# --- domain tables -----------------------------------------------------------------------------------------------


@query
def road_vertices(t: Domain) -> DataFrame:
    return t.road_vertex


@query
def road_edges(t: Domain) -> DataFrame:
    return t.road_edge


@query
def users_placed(t: Domain) -> DataFrame:
    return t.users.select(*six("u", "ni", "nj", "dist", "dis~"))


@query
def pois_placed(t: Domain) -> DataFrame:
    return t.pois.select(*six("p", "ni", "nj", "dist", "dis~"))


@query
def user_terms(t: Domain) -> DataFrame:
    return t.user_term


@query
def poi_terms(t: Domain) -> DataFrame:
    return t.poi_term


@query
def checkins(t: Domain) -> DataFrame:
    return t.checkin


@query
def friends(t: Domain) -> DataFrame:
    return t.friend


@query
def friends_undirected(t: Domain) -> DataFrame:
    return t.friend_und


# --- cleaning ----------------------------------------------------------------------------------------------------


def _raw_edges(t: Domain) -> DataFrame:
    """Edges both ways, with a loop at each end."""
    e = t.road_edge.select("ni", "nj", "dist")
    turned = e.select(F.col("nj").alias("ni"), F.col("ni").alias("nj"), (F.col("dist") + 1).alias("dist"))
    return e.unionByName(turned).unionByName(e.select("ni", F.col("ni").alias("nj"), "dist"))


@query
def edges_dedup_undirected(t: Domain) -> DataFrame:
    return clean.dedup_undirected(_raw_edges(t))


@query
def edges_euclid_floor(t: Domain) -> DataFrame:
    far = t.road_vertex.select("v", (F.col("x") * 9).alias("x"), (F.col("y") * 9).alias("y"))
    return clean.euclid_floor(t.road_edge.select("ni", "nj", "dist"), far)


@query
def degree_histogram(t: Domain) -> DataFrame:
    return clean.degree_histogram(t.road_edge)


@query
def duplicate_coordinates(t: Domain) -> DataFrame:
    folded = t.road_vertex.select("v", (F.col("x") % 3).alias("x"), "y")
    return clean.duplicate_coordinates(folded)


@query
def drop_isolated(t: Domain) -> DataFrame:
    return clean.drop_isolated(t.road_vertex, t.road_edge.where("ni % 7 <> 0 and nj % 7 <> 0"))


@query
def drop_vertices(t: Domain) -> DataFrame:
    """Roads that are left without the vertices of every fifth number."""
    return clean.drop_vertices(t.road_vertex, t.road_edge, t.road_vertex.where("v % 5 = 2").select("v"))[1].select("ni", "nj", "dist")


@query
def pseudo_diameter(t: Domain) -> DataFrame:
    return t.spark.createDataFrame([(float(clean.pseudo_diameter(t.road_edge, 12)),)], "far double")


@query
def largest_component(t: Domain) -> DataFrame:
    return clean.largest_component(t.road_vertex, t.road_edge.where("(ni + nj) % 3 <> 0"))


@query
def component_labels(t: Domain) -> DataFrame:
    return clean.component_labels(t.road_vertex, t.road_edge.where("(ni + nj) % 3 <> 0"))


@query
def dense_reid(t: Domain) -> DataFrame:
    """Users with check-ins, numbered anew."""
    some = t.checkin.select("u").distinct()
    return clean.dense_ids(some, "u", [F.asc("u")]).select("u", "id")


@query
def term_rank_by_df(t: Domain) -> DataFrame:
    return clean.term_rank_by_df(t.poi_term)


@query
def friends_capped(t: Domain) -> DataFrame:
    return clean.cap_ids(t.friend, "u", "v", 100)


@query
def coordinate_ranges(t: Domain) -> DataFrame:
    return clean.coordinate_ranges(t.road_vertex)


# --- synthetic data ----------------------------------------------------------------------------------------------


@query
def zipf_target_freq(t: Domain) -> DataFrame:
    return synth.zipf_targets(clean.term_rank_by_df(t.poi_term), t.n_pois)


@query
def zipf_deficit(t: Domain) -> DataFrame:
    return synth.zipf_deficit(synth.zipf_targets(clean.term_rank_by_df(t.poi_term), t.n_pois))


@query
def zipf_rewrite(t: Domain) -> DataFrame:
    return synth.zipf_rewrite(t.poi_term, synth.zipf_targets(clean.term_rank_by_df(t.poi_term), t.n_pois), t.n_pois)


@query
def zipf_shares(t: Domain) -> DataFrame:
    return synth.zipf_shares(clean.term_rank_by_df(t.poi_term).select("rank"), 1.0).select(*six("rank", "cum~"))


def _subset(percent: int) -> None:
    def f(t: Domain) -> DataFrame:
        return synth.hash_subset(t.pois.select("p"), "p", percent)

    f.__name__ = f"subset_{percent}"
    query(f)


for _percent in (60, 70, 80, 90):
    _subset(_percent)


@query
def hash_sample(t: Domain) -> DataFrame:
    return synth.hash_sample(t.users.select("u"), "u", 50)


@query
def hash_pairs(t: Domain) -> DataFrame:
    return synth.hash_pairs(t.road_vertex, "v", 40)


@query
def distance_buckets(t: Domain) -> DataFrame:
    return synth.distance_buckets(_apsp(t).where("s = 12").select("t", "d"), 4)


# --- text and social ---------------------------------------------------------------------------------------------


def _idf(t: Domain) -> DataFrame:
    return text.term_idf(t.poi_term, t.n_pois)


@query
def term_idf(t: Domain) -> DataFrame:
    return _idf(t).select(*six("term", "df", "idf~"))


@query
def posting_size(t: Domain) -> DataFrame:
    return text.posting_sizes(t.user_term, t.poi_term)


@query
def relevance_pairs(t: Domain) -> DataFrame:
    return text.relevance(t.user_term, t.poi_term, _idf(t)).select(*six("u", "p", "rel~"))


@query
def group_keywords(t: Domain) -> DataFrame:
    return text.group_keywords(t.poi_term, t.query_poi)


@query
def group_keywords_le200(t: Domain) -> DataFrame:
    """Terms of a group with numbers up to 200: the ranks take the part of term numbers."""
    rank = clean.term_rank_by_df(t.poi_term)
    return text.group_keywords(t.poi_term, t.query_poi).join(rank, "term").where("rank <= 200").select("term", "rank")


@query
def extended_jaccard(t: Domain) -> DataFrame:
    """Of the terms of places' users, place against place."""
    return text.node_jaccard(t.poi_user_term.withColumnRenamed("p", "node"))


@query
def first_terms(t: Domain) -> DataFrame:
    return text.first_terms(t.poi_term, 3).select("p", F.concat_ws(",", "terms").alias("terms"))


@query
def friend_checkin_counts(t: Domain) -> DataFrame:
    return social.friend_checkins(t.friend, t.checkin)


@query
def max_friend_checkin(t: Domain) -> DataFrame:
    return social.most_friends(social.friend_checkins(t.friend, t.checkin))


@query
def social_score(t: Domain) -> DataFrame:
    return social.social_score(social.friend_checkins(t.friend, t.checkin)).select(*six("u", "p", "soc~"))


# --- roads -------------------------------------------------------------------------------------------------------


def _apsp(t: Domain) -> DataFrame:
    return road.apsp(t.road_vertex, t.road_edge)


@query
def apsp(t: Domain) -> DataFrame:
    return _apsp(t)


def _index(t: Domain) -> BorderIndex:
    return border_index(t.road_vertex, t.road_edge)


@query
def label_distance(t: Domain) -> DataFrame:
    """All pairs of vertices, from labels."""
    pairs = t.road_vertex.select(F.col("v").alias("s")).join(t.road_vertex.select(F.col("v").alias("t")), F.lit(True))
    return _index(t).distances(pairs)


@query
def spsp(t: Domain) -> DataFrame:
    """Each vertex and its mirror image."""
    return _index(t).distances(t.road_vertex.select(F.col("v").alias("s"), (24 - F.col("v")).alias("t")))


@query
def border_labels(t: Domain) -> DataFrame:
    return _index(t).label.select(F.col("level").cast("long").alias("level"), "v", "hub", *six("d~"))


@query
def sssp(t: Domain) -> DataFrame:
    source = t.road_vertex.where("v = 0 or v = 12").select(F.col("v").alias("s"))
    return road.sssp(t.road_edge, source).select("s", "t", "d")


@query
def user_poi_distance(t: Domain) -> DataFrame:
    pairs = t.users.select("u").crossJoin(t.query_poi)
    return road.with_distance(pairs, t.users, t.pois, _apsp(t)).select(*six("u", "p", "dist~"))


@query
def knn_objects(t: Domain) -> DataFrame:
    rows = road.vertex_place(_apsp(t), t.pois, "p").withColumn("dist", F.round("dist", 9))
    return road.nearest(rows, ["v"], ["dist", "p"], 5).select(*six("v", "p", "dist~", "rank"))


@query
def network_knn_users(t: Domain) -> DataFrame:
    pairs = t.users.select("u").crossJoin(t.query_poi)
    rows = road.with_distance(pairs, t.users, t.pois, _apsp(t)).withColumn("dist", F.round("dist", 9))
    return road.nearest(rows, ["p"], ["dist", "u"], 10).select(*six("p", "u", "dist~", "rank"))


@query
def landmark_bounds(t: Domain) -> DataFrame:
    return road.landmark_bounds(_apsp(t), t.road_vertex.where("v in (0, 4, 20, 24)"))


@query
def partition_leaves(t: Domain) -> DataFrame:
    return road.partition(t.road_vertex)


@query
def node_ancestors(t: Domain) -> DataFrame:
    return road.ancestors(road.partition(t.road_vertex))


@query
def partition_borders(t: Domain) -> DataFrame:
    return road.borders(road.partition(t.road_vertex), t.road_edge)


@query
def leaf_distance_bounds(t: Domain) -> DataFrame:
    return road.leaf_bounds(road.partition(t.road_vertex), t.road_edge, _apsp(t))


@query
def node_distance_bounds(t: Domain) -> DataFrame:
    return road.node_bounds(road.leaf_bounds(road.partition(t.road_vertex), t.road_edge, _apsp(t)))


@query
def leaf_diameter(t: Domain) -> DataFrame:
    return road.leaf_diameter(road.partition(t.road_vertex), _apsp(t))


@query
def first_hops(t: Domain) -> DataFrame:
    return road.first_hops(_apsp(t), t.road_edge)


@query
def euclid_knn(t: Domain) -> DataFrame:
    return road.euclid_knn(t.road_vertex, t.road_vertex, 4).select(*six("q", "v", "dist~")).withColumn("dist", F.col("dist"))


@query
def window_rectangle(t: Domain) -> DataFrame:
    return road.window_rectangle(t.road_vertex, 1, 1, 3, 2)


@query
def point_rectangles(t: Domain) -> DataFrame:
    """Least and largest distance of each vertex to a rectangle."""
    near, far = point_rect(F.col("x"), F.col("y"), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return t.road_vertex.select("v", near.alias("near"), far.alias("far")).select(*six("v", "near~", "far~"))


@query
def morton_codes(t: Domain) -> DataFrame:
    return t.road_vertex.select("v", morton(F.col("x"), F.col("y"), 4).alias("code"))


@query
def edge_keys(t: Domain) -> DataFrame:
    key = edge_key(F.col("ni"), F.col("nj"), 25)
    a, b = edge_ends(F.col("key"), 25)
    return t.road_edge.select(key.alias("key")).select("key", a.cast("long").alias("ni"), b.alias("nj"))


@query
def junction_chains(t: Domain) -> DataFrame:
    return road.junction_chains(t.road_edge.where("(ni + nj) % 3 <> 0"))


# --- scores and rankings -----------------------------------------------------------------------------------------


def _scores(t: Domain) -> ranking.Scores:
    return ranking.Scores(t, _apsp(t))


@query
def gsk_score(t: Domain) -> DataFrame:
    return ranking.all_pairs(_scores(t))


@query
def gsk_score_indexed(t: Domain) -> DataFrame:
    """The same from border matrices instead of all pairs of vertices."""
    return ranking.all_pairs(ranking.Scores(t, _index(t))).select("u", "p", "score")


@query
def sk_score(t: Domain) -> DataFrame:
    """Without the social part: influence is one."""
    return ranking.all_pairs(ranking.Scores(t, _apsp(t), a=0)).select("u", "p", "score")


def _bounds(t: Domain, pois: DataFrame | None = None) -> DataFrame:
    """(u, p, rel, dmin, dmax), of some places if these are given, from the distances of the leaves of a user's and a
    place's lower ends: no exact distance
    is made."""
    d = _apsp(t)
    leaves = road.partition(t.road_vertex)
    longest = t.road_edge.agg(F.max("dist").alias("m")).first()["m"]
    span = d.join(leaves.select(F.col("v").alias("s"), F.col("leaf").alias("l1")), "s").join(leaves.select(F.col("v").alias("t"), F.col("leaf").alias("l2")), "t")
    span = span.groupBy("l1", "l2").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    us = t.users.join(leaves.withColumnRenamed("v", "ni"), "ni").select("u", F.col("leaf").alias("l1"))
    ps = t.pois.join(leaves.withColumnRenamed("v", "ni"), "ni").select("p", F.col("leaf").alias("l2"))
    rel = text.relevance(t.user_term, t.poi_term if pois is None else t.poi_term.join(pois, "p", "left_semi"), _idf(t))
    rows = rel.join(us, "u").join(ps, "p").join(span, ["l1", "l2"])
    return rows.select("u", "p", "rel", F.greatest(F.col("lo") - 2 * longest, F.lit(0.0)).alias("dmin"), (F.col("hi") + 2 * longest).alias("dmax"))


@query
def gsk_bounds(t: Domain) -> DataFrame:
    b = _bounds(t)
    rows = b.select("u", "p", lower_score(F.col("rel"), F.col("dmax")).alias("low"), upper_score(F.col("rel"), F.col("dmin"), BASE).alias("top"))
    return rows.select(*six("u", "p", "low~", "top~"))


@query
def nearest_poi_by_term(t: Domain) -> DataFrame:
    return _cells(t).select(*six("term", "v", "p", "dist~"))


def _cells(t: Domain) -> DataFrame:
    rows = road.vertex_place(_apsp(t), t.pois, "p").withColumn("dist", F.round("dist", 9))
    return voronoi.nearest_by_term(t.poi_term, rows)


@query
def voronoi_adjacency(t: Domain) -> DataFrame:
    return voronoi.adjacency(_cells(t), t.road_edge)


@query
def voronoi_leaves(t: Domain) -> DataFrame:
    return voronoi.by_leaf(_cells(t), road.partition(t.road_vertex))


def _best(t: Domain) -> ranking.Best | ranking.ByPairs:
    return ranking.best_places(_scores(t), t.k)


@query
def user_topk(t: Domain) -> DataFrame:
    return _best(t).topk().select(*six("u", "p", "score~", "rank"))


@query
def user_kth_score(t: Domain) -> DataFrame:
    return _best(t).kth().select(*six("u", "rk~"))


_RESULT = ("p", "u", "rel~", "inf~", "dist~", "score~", "rk~")


@query
def reverse_topk_batch(t: Domain) -> DataFrame:
    return _reverse(t).select(*six(*_RESULT))


@query
def reverse_topk_single(t: Domain) -> DataFrame:
    return _best(t).reverse(t.query_poi.where("p = 0")).select(*six(*_RESULT))


@query
def reverse_topk_nonstrict(t: Domain) -> DataFrame:
    return _best(t).reverse(t.query_poi, strict=False).select(*six(*_RESULT))


@query
def reverse_topk_bound(t: Domain) -> DataFrame:
    t.user_term, t.poi_term = cut(t.user_term, "user_term"), cut(t.poi_term, "poi_term")  # for the bounds and the scores
    return ranking.reverse_topk_bound(_scores(t), t.query_poi, t.k, _bounds(t, t.query_poi), _best(t)).select(*six(*_RESULT))


@query
def reverse_topk_given_keywords(t: Domain) -> DataFrame:
    """Place 0 with the keywords of the whole group."""
    words = text.group_keywords(t.poi_term, t.query_poi).withColumn("p", F.lit(0).cast("long"))
    return ranking.reverse_keywords(_scores(t), words, t.k).select(*six(*_RESULT))


@query
def reverse_topk_group_keywords(t: Domain) -> DataFrame:
    """Each place of the query with the keywords of the whole group."""
    words = text.group_keywords(t.poi_term, t.query_poi).join(F.broadcast(t.query_poi), F.lit(True))
    return ranking.reverse_keywords(_scores(t), words, t.k).select(*six(*_RESULT))


@query
def reverse_topk_location(t: Domain) -> DataFrame:
    """A bare location, the middle of road 7, with two keywords."""
    place = t.road_edge.where("eid = 7").select(F.lit(-1).cast("long").alias("p"), "ni", "nj", "dist", (F.col("dist") / 2).alias("dis"))
    words = t.spark.createDataFrame([(-1, "Brand#11"), (-1, "Brand#22")], "p long, term string")
    return ranking.reverse_keywords(_scores(t), words, t.k, place).select(*six(*_RESULT))


@query
def vertex_term_kth(t: Domain) -> DataFrame:
    """The third best lower score of a place with a term at each vertex."""
    rows = t.poi_term.join(_idf(t), "term").join(road.vertex_place(_apsp(t), t.pois, "p"), "p")
    scored = rows.select("v", "term", "p", F.round(lower_score(F.col("idf"), F.col("dist")), 9).alias("score"))
    return ranking.per_term_topk(scored, 3).select(*six("v", "term", "rk~"))


@query
def reverse_cardinality(t: Domain) -> DataFrame:
    return _reverse(t).groupBy("p").agg(F.count("*").alias("n"))


@query
def candidate_groups(t: Domain) -> DataFrame:
    return workload.candidate_groups(_best(t).topk())


@query
def pois_of_terms(t: Domain) -> DataFrame:
    return workload.pois_of_terms(t.poi_term, ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"], 20)


@query
def keyword_pool(t: Domain) -> DataFrame:
    return workload.keyword_pool(_idf(t), 1, 1000, 10)


# --- diffusion ---------------------------------------------------------------------------------------------------


def _edges(t: Domain) -> DataFrame:
    return diffusion.edge_probability(t.friend_und)


@query
def edge_prob_wc(t: Domain) -> DataFrame:
    return _edges(t).select(*six("u", "v", "prob~"))


@query
def edge_prob_uniform(t: Domain) -> DataFrame:
    return diffusion.edge_probability(t.friend_und, "uniform", 0.05)


@query
def edge_prob_trivalency(t: Domain) -> DataFrame:
    return diffusion.edge_probability(t.friend_und, "trivalency")


@query
def live_edges(t: Domain) -> DataFrame:
    return diffusion.live_edges(_edges(t), ROUNDS)


def _seeds(t: Domain) -> DataFrame:
    """Places of the query with all users who checked in there."""
    return t.checkin.join(t.query_poi, "p", "left_semi").select("p", "u").distinct()


@query
def reachable_users(t: Domain) -> DataFrame:
    return selection.reachable_users(_seeds(t).where("p = 0"), t.friend_und).select("node")


@query
def rr_users(t: Domain) -> DataFrame:
    return diffusion.rr_users(_edges(t), diffusion.rr_roots(t.spark, ROUNDS, t.n_users)).select("round", "node")


@query
def rr_pois(t: Domain) -> DataFrame:
    return diffusion.rr_pois(diffusion.rr_users(_edges(t), diffusion.rr_roots(t.spark, ROUNDS, t.n_users)), _seeds(t))


@query
def rr_pois_outer(t: Domain) -> DataFrame:
    return diffusion.rr_pois(diffusion.rr_users(_edges(t), diffusion.rr_roots(t.spark, ROUNDS, t.n_users)), _seeds(t), 2)


@query
def mc_spread_ic(t: Domain) -> DataFrame:
    return diffusion.spread_ic(_edges(t), _seeds(t).where("p = 0"), ROUNDS).select(*six("spread~"))


@query
def mc_spread_lt(t: Domain) -> DataFrame:
    return diffusion.spread_lt(_edges(t), _seeds(t).where("p = 0"), ROUNDS).select(*six("spread~"))


# --- selection ---------------------------------------------------------------------------------------------------


@query
def one_hop_spread(t: Domain) -> DataFrame:
    return diffusion.one_hop(_seeds(t), _edges(t)).select(*six("p", "spread~"))


@query
def one_hop_spread_outer(t: Domain) -> DataFrame:
    return diffusion.one_hop(_seeds(t), _edges(t), exclude_seeds=True).select(*six("p", "spread~"))


def _reverse(t: Domain) -> DataFrame:
    return _best(t).reverse(t.query_poi)


@query
def select_cardinality(t: Domain) -> DataFrame:
    return selection.by_cardinality(_reverse(t), 3)


@query
def select_relevance(t: Domain) -> DataFrame:
    s = _scores(t)
    rel = s.relevant().join(t.query_poi, "p", "left_semi")
    return selection.by_relevance(road.with_distance(rel, t.users, t.pois, s.d), 3, 20)


@query
def select_influencer(t: Domain) -> DataFrame:
    return selection.by_influencers(_reverse(t), _edges(t), 3)


@query
def select_random(t: Domain) -> DataFrame:
    return selection.by_chance(t.pois, BUDGET)


@query
def greedy_step1_cover(t: Domain) -> DataFrame:
    sets = diffusion.rr_pois(diffusion.rr_users(_edges(t), diffusion.rr_roots(t.spark, ROUNDS, t.n_users)), _seeds(t))
    return sets.groupBy("p").agg(F.count("*").alias("gain"))


@query
def rr_cover(t: Domain) -> DataFrame:
    sets = diffusion.rr_pois(diffusion.rr_users(_edges(t), diffusion.rr_roots(t.spark, ROUNDS, t.n_users)), _seeds(t))
    return sets.where("p < 2").agg(F.countDistinct("round").alias("covered"))


def _links(t: Domain) -> DataFrame:
    return cut(_reverse(t).select("p", "u"), "reverse")


@query
def select_greedy_onehop(t: Domain) -> DataFrame:
    return selection.greedy_one_hop(_links(t), cut(_edges(t), "edges"), 3).frame(t.spark).select(*six("step", "p", "gain~"))


@query
def select_opimc(t: Domain) -> DataFrame:
    return selection.opimc(t.spark, cut(_edges(t), "edges"), _links(t), t.n_users, 5, 3).frame(t.spark, "sets", "ratio", "estimate")


@query
def select_hybrid(t: Domain) -> DataFrame:
    edges, links = cut(_edges(t), "edges"), _links(t)
    return selection.opimc(t.spark, edges, links, t.n_users, 5, 3, local=cut(diffusion.one_hop(links, edges), "local")).frame(t.spark, "sets", "ratio", "estimate")


@query
def select_imm(t: Domain) -> DataFrame:
    return selection.imm(t.spark, cut(_edges(t), "edges"), _links(t), t.n_users, 5, 3).frame(t.spark, "sets", "low", "estimate")


@query
def select_celf(t: Domain) -> DataFrame:
    return selection.celf(t.spark, cut(_edges(t), "edges"), _links(t), 3, GRAPHS).frame(t.spark).select(*six("step", "p", "gain~"))


@query
def select_pmc(t: Domain) -> DataFrame:
    return selection.pmc(t.spark, cut(_edges(t), "edges"), _links(t), 3, GRAPHS).frame(t.spark).select(*six("step", "p", "gain~"))


@query
def select_heuristic(t: Domain) -> DataFrame:
    return selection.heuristic(_links(t), cut(_edges(t), "edges"), 3).frame(t.spark)


