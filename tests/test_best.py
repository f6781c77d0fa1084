"""Best places by classes of users against all scored pairs."""

import os

import pytest

from tidemark.operators import ranking, road, text
from tidemark.operators.best import Best
from tidemark.sources.fixtures import Domain

DATA = "/root/testdata/sf0.001"


class Made:
    """Three users on two roads: 0 and 1 of one class, 2 with other terms; 0's friends visit a far place."""

    def __init__(self, spark):
        of = spark.createDataFrame
        self.spark, self.n_pois, self.n_users = spark, 5, 3
        self.road_vertex = of([(i, float(i), 0.0) for i in range(3)], "v long, x double, y double")
        self.road_edge = of([(0, 0, 1, 4.0), (1, 1, 2, 6.0)], "eid long, ni long, nj long, dist double")
        self.users = of([(0, 0, 1, 4.0, 1.0), (1, 0, 1, 4.0, 1.0), (2, 1, 2, 6.0, 2.0)], "u long, ni long, nj long, dist double, dis double")
        self.pois = of([(0, 0, 1, 4.0, 2.0), (1, 0, 1, 4.0, 2.0), (2, 1, 2, 6.0, 5.0), (3, 0, 1, 4.0, 0.0), (4, 1, 2, 6.0, 6.0)], "p long, ni long, nj long, dist double, dis double")
        self.user_term = of([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "c")], "u long, term string")
        self.poi_term = of([(0, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "b"), (3, "z"), (4, "b"), (4, "z")], "p long, term string")
        self.friend = of([(0, 1), (0, 2), (1, 2)], "u long, v long")
        self.checkin = of([(4, 1, 1), (4, 2, 3), (0, 2, 1), (3, 0, 1)], "p long, u long, cnt long")


def rows(df, *cols):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def alike(scores, pois, k):
    by = Best(scores, k), ranking.ByPairs(scores, k)
    assert by[0].fits
    one, two = (rows(b.topk(), "u", "p", "score", "rank") for b in by)
    assert one == two and one
    assert rows(by[0].kth(), "u", "rk") == rows(by[1].kth(), "u", "rk")
    out = "p", "u", "rel", "inf", "dist", "score", "rk"
    for strict in (True, False):
        assert rows(by[0].reverse(pois, strict), *out) == rows(by[1].reverse(pois, strict), *out)


@pytest.mark.parametrize("k, a", [(1, 6.0), (2, 6.0), (2, 0.5), (3, 0), (9, 6.0)])
def test_made(spark, k, a):
    t = Made(spark)
    scores = ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge), a=a)
    alike(scores, t.pois.select("p"), k)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_domain(spark):
    t = Domain(spark, DATA)
    alike(ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge)), t.query_poi, t.k)


@pytest.mark.parametrize("a", [6.0, 0])
def test_all_pairs_by_kinds_of_places(spark, a):
    t = Made(spark)
    scores = ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge), a=a)
    out = "u", "p", "rel", "inf", "dist", "score"
    want = rows(scores.scored(), *out)
    scores.scored = None
    assert rows(ranking.all_pairs(scores, 9), *out) == want and want


@pytest.mark.parametrize("a, chunk", [(6.0, 1), (6.0, 64), (0, 1), (0, 64)])
def test_pairs_are_scored_before_they_are_unfolded(spark, monkeypatch, a, chunk):
    """What an explode does not read, Spark works out behind it, for each row: so scores pass through one by themselves."""
    monkeypatch.setattr("tidemark.operators.best.CHUNK", chunk, raising=False)
    t = Made(spark)
    scores = ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge), a=a)
    got, out = ranking.all_pairs(scores, 9), ("u", "p", "rel", "inf", "dist", "score")
    made = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert any("round(" in x for x in made)
    assert rows(got, *out) == rows(scores.scored(), *out)


def test_similarity_of_nodes_by_classes(spark):
    """Pairs of nodes are unfolded from pairs of classes: no product is summed for each of them."""
    kinds = [{"a": 1, "b": 2}, {"b": 3}, {"c": 5}, {"a": 4, "c": 1}]
    of = {n: kinds[n * n % 7 % 4] for n in range(24)}
    counts = spark.createDataFrame([(n, t, c) for n, k in of.items() for t, c in k.items()], "node long, term string, cnt long")
    got = text.node_jaccard(counts)
    want = []
    for n in of:
        for m in range(n + 1, 24):
            dot = sum(c * of[m].get(t, 0) for t, c in of[n].items())
            if dot:
                want.append((n, m, round(dot / (sum(c * c for c in of[n].values()) + sum(c * c for c in of[m].values()) - dot), 6)))
    assert rows(got, "n1", "n2", "sim") == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most, tile", [(512, 1024), (512, 7), (2, 1024)])
def test_similarity_of_nodes_that_all_differ(spark, monkeypatch, most, tile):
    """Where no nodes are equal, nothing is written for pairs of them; with more terms than `most` it goes by classes."""
    written, cut = [], text.cut
    monkeypatch.setattr(text, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    monkeypatch.setattr(text, "MOST_TILE_TERMS", most, raising=False)
    monkeypatch.setattr(text, "TILE", tile, raising=False)
    of = {3 * n - 50: {t: c for t, c in (("a", n % 5), ("b", n // 5), ("c", n * (n % 2)), ("d", n % 3)) if c} for n in range(1, 60)}
    assert len({tuple(k.items()) for k in of.values()}) == len(of)
    got = text.node_jaccard(spark.createDataFrame([(n, t, c) for n, k in of.items() for t, c in k.items()], "node long, term string, cnt long"))
    want = []
    for n in of:
        for m in of:
            dot = sum(c * of[m].get(t, 0) for t, c in of[n].items())
            if n < m and dot:
                want.append((n, m, round(dot / (sum(c * c for c in of[n].values()) + sum(c * c for c in of[m].values()) - dot), 6)))
    assert rows(got, "n1", "n2", "sim") == want
    assert most < 4 or all(w.count() <= len(of) for w in written)


def test_six_places_are_those_of_spark(spark):
    import numpy as np

    from tidemark.operators.text import six_places

    x = np.concatenate([np.arange(1, 20001, 2) / 2e6, np.arange(1, 2000) / 64e4, np.arange(1, 3000) / 7919])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("x", "round(x, 6) y").collect()
    assert six_places(np.array([r["x"] for r in got])).tolist() == [r["y"] for r in got]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_users_terms_by_place(spark):
    t = Domain(spark, DATA)
    want = t.checkin.join(t.user_term, "u").groupBy("p", "term").count()
    assert rows(t.poi_user_term, "p", "term", "cnt") == rows(want, "p", "term", "count")


def test_no_table_of_all_pairs(spark):
    """Without the scored pairs, the queries still have their result."""
    t = Made(spark)
    scores = ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge))
    want = rows(ranking.user_topk(scores.scored(), 2), "u", "p", "score", "rank")
    scores.scored = None
    assert rows(ranking.best_places(scores, 2).topk(), "u", "p", "score", "rank") == want


def test_too_many_terms_go_by_pairs(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.best.MOST_USER_TERMS", 1)
    t = Made(spark)
    scores = ranking.Scores(t, road.apsp(t.road_vertex, t.road_edge))
    best = ranking.best_places(scores, 2)
    assert isinstance(best, ranking.ByPairs) and best.topk().count() == 5


def test_candidates_of_bounds_are_made_once(spark, monkeypatch):
    """The users whom bounds leave are read more than once, so what they come from is not to be made each time."""
    given = []
    monkeypatch.setattr(ranking.Best, "__init__", lambda self: None)
    monkeypatch.setattr(ranking.Best, "floors", lambda self: spark.createDataFrame([(1, 0.1), (2, 9.0)], "u long, floor double"))
    monkeypatch.setattr(ranking.Best, "reverse", lambda self, pois, users: given.append(users) or users)
    bounds = spark.createDataFrame([(1, 0, 1.0, 0.0, 1.0), (2, 0, 1.0, 0.0, 1.0)], "u long, p long, rel double, dmin double, dmax double")
    scores = ranking.Scores(None, None)
    got = ranking.reverse_topk_bound(scores, spark.createDataFrame([(0,)], "p long"), 1, bounds, ranking.Best())
    assert [r["u"] for r in got.collect()] == [1]
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
