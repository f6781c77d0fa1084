"""Small hand-made cases: distances on one edge, no friends, too few places, ties, loops, cycles."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geosocial import gsk_score, influence, morton, unmorton
from tidemark.operators import clean, diffusion, ranking, road, selection, social, text
from tidemark.plans.cuts import cut


@pytest.fixture
def line(spark):
    """0 -4- 1 -6- 2, and 3 apart."""
    v = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "v long, x double, y double")
    e = spark.createDataFrame([(0, 1, 4.0), (1, 2, 6.0)], "ni long, nj long, dist double")
    return v, e


def test_distances(spark, line):
    v, e = line
    d = road.apsp(v, e)
    got = {(r["s"], r["t"]): r["d"] for r in d.collect()}
    assert got[0, 2] == 10 and (0, 3) not in got
    one = {(r["s"], r["t"]): (r["d"], r["pred"]) for r in road.sssp(e, spark.createDataFrame([(0,)], "s long")).collect()}
    assert one[0, 2] == (10, 1) and one[0, 0] == (0, None)
    assert road.shortest_path(road.sssp(e, spark.createDataFrame([(0,)], "s long")), 0, 2) == [0, 1, 2]
    users = spark.createDataFrame([(1, 0, 1, 4.0, 1.0), (2, 0, 1, 4.0, 0.0)], "u long, ni long, nj long, dist double, dis double")
    pois = spark.createDataFrame([(7, 0, 1, 4.0, 3.0), (8, 1, 2, 6.0, 2.0)], "p long, ni long, nj long, dist double, dis double")
    pairs = users.select("u").crossJoin(pois.select("p"))
    far = {(r["u"], r["p"]): r["dist"] for r in road.with_distance(pairs, users, pois, d).collect()}
    assert far == {(1, 7): 2.0, (2, 7): 3.0, (1, 8): 5.0, (2, 8): 6.0}


def test_social(spark):
    friend = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "u long, v long")
    checkin = spark.createDataFrame([(7, 2, 1), (7, 3, 9), (8, 3, 1)], "p long, u long, cnt long")
    got = {(r["u"], r["p"]): r["soc"] for r in social.social_score(social.friend_checkins(friend, checkin)).collect()}
    assert got == {(1, 7): 1.0, (1, 8): 0.5}


def test_scores(spark):
    one = spark.range(1)
    inf = lambda s, a=6.0, alpha=0.6: one.select(influence(F.lit(s), a, alpha).alias("x")).first()["x"]
    assert inf(0.0) == 1 and inf(0.5, a=0) == 1 and inf(0.5, alpha=0) == 1 and inf(1.0) == 7
    assert one.select(gsk_score(F.lit(0.0), F.lit(7.0), F.lit(0.0)).alias("x")).first()["x"] == 0


def test_relevance_with_terms_of_all(spark):
    poi = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (1, "b")], "p long, term string")
    user = spark.createDataFrame([(9, "a"), (9, "b"), (8, "a")], "u long, term string")
    got = {(r["u"], r["p"]): r["rel"] for r in text.relevance(user, poi, text.term_idf(poi, 2)).collect()}
    assert got == {(9, 1): 1.0}


def test_reverse_at_the_edge(spark):
    """A place exactly at rank k is in with strict=False only; users with fewer than k places have no bound."""
    scored = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0), (2, 11, 0.5)], "u long, p long, score double").selectExpr("u", "p", "1.0 rel", "1.0 inf", "0.0 dist", "score")
    ask = spark.createDataFrame([(11,)], "p long")
    assert {r["u"] for r in ranking.reverse_topk(scored, ask, 2).collect()} == {2}
    assert {r["u"] for r in ranking.reverse_topk(scored, ask, 2, strict=False).collect()} == {1, 2}


def test_cleaning(spark, line):
    raw = spark.createDataFrame([(1, 1, 2.0), (2, 1, 5.0), (1, 2, 3.0), (0, 1, -1.0)], "ni long, nj long, dist double")
    assert [tuple(r) for r in clean.dedup_undirected(raw).collect()] == [(1, 2, 3.0)]
    v, e = line
    assert sorted(r["v"] for r in clean.largest_component(v, e).collect()) == [0, 1, 2]
    ids = clean.dense_ids(spark.range(5, 25).selectExpr("id * 3 AS u"), "u", [F.desc("u")]).collect()
    assert sorted((r["id"], r["u"]) for r in ids) == [(i, 72 - 3 * i) for i in range(20)]


def test_cycle_and_seeds(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "u long, v long, prob double")
    seeds = spark.createDataFrame([(1,)], "u long")
    assert diffusion.spread_ic(edges, seeds, 3).first()["spread"] == 3
    assert diffusion.spread_lt(edges, seeds, 3).first()["spread"] == 3
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "p long, u long")
    hop = {r["p"]: r["spread"] for r in diffusion.one_hop(links, edges).collect()}
    assert hop == {7: pytest.approx(4), 8: pytest.approx(2)}  # 2 is a seed and reached by one
    hop = {r["p"]: r["spread"] for r in diffusion.one_hop(links, edges, exclude_seeds=True).collect()}
    assert hop[7] == pytest.approx(3)


def test_greedy_cover(spark):
    sets = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (2, 3), (0, 3)], "round long, p long")
    got = selection.greedy_cover(sets, 2)
    assert got.pois == [2, 1] and got.gains == [3, 2] and got.facts["covered"] == 5 <= got.facts["upper"]


def test_morton_back(spark):
    df = spark.range(50).selectExpr("id % 7 AS x", "id AS y").withColumn("c", morton(F.col("x"), F.col("y")))
    a, b = unmorton(F.col("c"))
    assert df.where((a != F.col("x")) | (b != F.col("y"))).count() == 0


def test_chains_and_rings(spark):
    """A path of 300 vertices, a ring, and a loop at a junction."""
    rows = [(i, i + 1, 1.0) for i in range(299)]
    rows += [(1000 + i, 1000 + (i + 1) % 7, 2.0) for i in range(7)]
    rows += [(2000, 2001, 1.0), (2001, 2002, 1.0), (2002, 2000, 1.0), (2000, 2003, 5.0)]
    got = {(r["a"], r["b"]): (r["end"], r["length"]) for r in road.junction_chains(spark.createDataFrame(rows, "ni long, nj long, dist double")).collect()}
    assert len(got) == 2 * len(rows)
    assert got[35, 34] == (0, 35.0) and got[35, 36] == (299, 264.0)
    assert got[1000, 1001] == (1000, 14.0) and got[1003, 1002] == (1003, 14.0)
    assert got[2000, 2001] == (2000, 3.0) and got[2001, 2002] == (2000, 2.0) and got[2003, 2000] == (2000, 5.0)
    assert road.junction_chains(spark.createDataFrame([], "ni long, nj long, dist double")).count() == 0


def test_border_index_by_dijkstra(spark):
    import heapq
    import random

    from tidemark.operators.border_index import border_index

    r, n = random.Random(3), 14
    at = {i: (i % n - 3, i // n - 3) for i in range(n * n)} | {900: (40, 40), 901: (41, 40)}
    edges = [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * n - n)]
    edges = [e for e in edges if r.random() < 0.8] + [(r.randrange(n * n), r.randrange(n * n)) for _ in range(6)] + [(900, 901)]
    edges = [(a, b, float(r.randint(1, 9))) for a, b in edges]
    v = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in at.items()], "v long, x double, y double")
    index = border_index(v, spark.createDataFrame(edges + edges[:2], "ni long, nj long, dist double"), shift=1)
    roads = {}
    for a, b, d in edges:
        roads.setdefault(a, []).append((b, d))
        roads.setdefault(b, []).append((a, d))
    pairs = [(s, t) for s in (0, 7, 100, 901) for t in at] + [(5, 5)]
    got = {(x["s"], x["t"]): x["d"] for x in index.distances(spark.createDataFrame(pairs + pairs[:3], "s long, t long")).collect()}
    want = {}
    for s in {s for s, _ in pairs}:
        seen, heap = {}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in seen:
                seen[x] = d
                for y, more in roads.get(x, []):
                    heapq.heappush(heap, (d + more, y))
        want |= {(s, t): seen[t] for t in at if (s, t) in set(pairs) and t in seen}
    assert got == want and (0, 901) not in got and got[901, 900] > 0


def test_paths_and_searches_that_do_not_end_early(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "ni long, nj long, dist double")
    tree = road.sssp(chain, spark.createDataFrame([(0,)], "s long"))
    assert road.shortest_path(tree, 0, 40) == list(range(41)) and road.shortest_path(tree, 0, 99) == []
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "u long, v long")
    got = {r["node"]: r["depth"] for r in diffusion.reach(spark.createDataFrame([(0,)], "node long"), links, ()).collect()}
    assert got == {i: i for i in range(41)}


def test_greedy_choices_by_brute_force(spark):
    """Greedy one-hop, CELF and PMC against the union of users and of what they reach."""
    import random

    r = random.Random(8)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(90)})
    edges = spark.createDataFrame([(u, v, r.choice([0.1, 0.5, 1.0])) for u, v in pairs if u != v], "u long, v long, prob double")
    prob = {(x["u"], x["v"]): x["prob"] for x in edges.collect()}
    links = sorted({(p, r.randrange(30)) for p in range(6) for _ in range(4)})
    df = spark.createDataFrame(links, "p long, u long")

    def spread(ps):
        us = {u for p, u in links if p in ps}
        miss = {}
        for (u, v), x in prob.items():
            if u in us:
                miss[v] = miss.get(v, 1.0) * (1 - x)
        return len(us) + sum(1 - m for m in miss.values())

    chosen, value = [], 0.0
    for _ in range(3):
        best = max((p for p in range(6) if p not in chosen), key=lambda p: (round(spread([*chosen, p]), 9), -p))
        chosen.append(best)
    got = selection.greedy_one_hop(df, edges, 3)
    assert got.pois == chosen and sum(got.gains) == pytest.approx(spread(chosen))
    rounds = 12
    for name, seed, choose in (("celf", 7, lambda: selection.celf(spark, edges, df, 4, rounds)), ("pmc", 5, lambda: selection.pmc(spark, edges, df, 4, rounds))):
        live = {(x["round"], x["u"], x["v"]) for x in diffusion.live_edges(edges, rounds, seed).collect()}
        hits = {}
        for p in range(6):
            seen = {(i, u) for q, u in links if q == p for i in range(rounds)}
            todo = list(seen)
            while todo:
                i, u = todo.pop()
                for v in range(30):
                    if (i, u, v) in live and (i, v) not in seen:
                        seen.add((i, v))
                        todo.append((i, v))
            hits[p] = seen
        chosen, covered = [], set()
        for _ in range(4):
            best = max((p for p in range(6) if p not in chosen), key=lambda p: (len(hits[p] - covered), -p))
            chosen.append((best))
            covered |= hits[best]
        got = choose()
        assert got.pois == chosen and sum(got.gains) == pytest.approx(len(covered) / rounds), name


def test_long_paths_take_few_searches(spark, monkeypatch):
    """A search goes many steps a job once few nodes are left; edges that are not live end it, and cycles do."""
    made = []
    monkeypatch.setattr(diffusion, "cut", lambda df, name="step": made.append(name) or cut(df, name))
    edges = spark.createDataFrame([(i, i + 1, 1.0 if i < 70 else 0.0) for i in range(80)] + [(50, 0, 1.0), (3, 3, 1.0)], "u long, v long, prob double")
    starts = spark.createDataFrame([(0, 0), (1, 68), (2, 75), (3, 99)], "round long, node long")
    got = {(r["round"], r["node"]): r["depth"] for r in diffusion.reach(starts, edges, live=F.col("prob") > 0.5).collect()}
    assert got == {(0, i): i for i in range(71)} | {(1, 68): 0, (1, 69): 1, (1, 70): 2, (2, 75): 0, (3, 99): 0}
    assert len(made) <= 12  # three steps a job are 25 searches


def test_sets_are_made_ahead_and_given_as_asked(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(selection, "rr_users", lambda *a: calls.append(a) or diffusion.rr_users(*a))
    edges = spark.createDataFrame([(i, (7 * i + j) % 30, 0.3) for i in range(30) for j in range(1, 4)], "u long, v long, prob double")
    links = spark.createDataFrame([(i % 3, i) for i in range(0, 30, 2)], "p long, u long")
    s = selection.Sampler(spark, edges, links, 30, 5, families=2)
    got = [sorted(map(tuple, s.sets(n).collect())) for n in (40, 80, 160)]
    assert len(calls) == 1 and s.asked == 160
    for n, rows in zip((40, 80, 160), got):
        roots = diffusion.rr_roots(spark, n, 30, 5).unionByName(diffusion.rr_roots(spark, n, 30, 5, selection.JUDGE))
        assert rows == sorted(map(tuple, diffusion.rr_pois(diffusion.rr_users(edges, roots, 5), links).collect()))
