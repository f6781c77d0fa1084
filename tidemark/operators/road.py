"""Road-network distances: all pairs on small graphs, frontier relaxation on large ones, and what builds on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geosocial import morton, place_distance, vertex_offset
from tidemark.plans.cuts import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, d) of undirected edges (ni, nj, dist), the shortest of parallel ones, no loops."""
    one = edges.select(F.col("ni").alias("a"), F.col("nj").alias("b"), F.col("dist").alias("d"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d"))


def apsp(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, t, d) for all pairs that a path joins, by min-plus squaring: for graphs of up to some thousands of vertices.

    A squaring doubles the number of edges that paths may have; sssp() is for larger graphs.
    """
    n = vertices.count()
    d = vertices.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0.0).alias("d")).unionByName(both_ways(edges).select(F.col("a").alias("s"), F.col("b").alias("t"), "d"))
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        left, right = d.select("s", F.col("t").alias("m"), F.col("d").alias("d1")), d.select(F.col("s").alias("m"), "t", F.col("d").alias("d2"))
        d = cut(left.join(right, "m").groupBy("s", "t").agg(F.min(F.col("d1") + F.col("d2")).alias("d")), "apsp")
    return d


def sssp(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, t, d, pred) from each source s (column s): relaxation of a shrinking frontier until nothing improves.

    pred is the vertex before t on a shortest path, the smallest of equals; null at the source.
    """
    roads = both_ways(edges)
    best = cut(sources.select("s", F.col("s").alias("t"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("pred")).distinct(), "sssp")
    frontier = best
    while True:
        step = frontier.join(roads, frontier["t"] == roads["a"]).select("s", F.col("b").alias("t"), (frontier["d"] + roads["d"]).alias("d"), F.col("a").alias("pred"))
        step = step.groupBy("s", "t").agg(F.min(F.struct("d", "pred")).alias("x")).select("s", "t", "x.d", "x.pred")
        old = best.select("s", "t", F.col("d").alias("od"), F.col("pred").alias("op"))
        better = (F.col("od").isNull()) | (F.col("d") < F.col("od")) | ((F.col("d") == F.col("od")) & F.col("op").isNotNull() & (F.col("pred") < F.col("op")))
        both = cut(old.join(step, ["s", "t"], "full").select("s", "t", F.when(better & F.col("d").isNotNull(), F.struct("d", "pred")).otherwise(F.struct(F.col("od").alias("d"), F.col("op").alias("pred"))).alias("x"), (better & F.col("d").isNotNull() & (F.col("od").isNull() | (F.col("d") < F.col("od")))).alias("new")), "sssp")
        best = both.select("s", "t", "x.d", "x.pred")
        frontier = both.where("new").select("s", "t", "x.d", "x.pred")
        if frontier.isEmpty():
            return best


def shortest_path(tree: DataFrame, source: int, target: int) -> list[int]:
    """Vertices of the path to a target in a result of sssp(), following predecessors; empty if there is none.

    Jumps over the predecessors double, so that a path of n vertices takes about log2(n) joins; then its vertices alone,
    which the jumps mark, reach the driver.
    """
    up = tree.where(F.col("s") == source).select("t", "d", F.coalesce("pred", "t").alias("up"))
    on = up.where(F.col("t") == target).select("t", "d")
    if on.isEmpty():
        return []
    while True:
        on = cut(on, "path")
        before = on.count()
        jumps = on.select("t").join(up.select("t", "up"), "t").select(F.col("up").alias("t")).join(up.select("t", "d"), "t")
        on = on.unionByName(jumps).distinct()
        if on.count() == before:
            return [r["t"] for r in on.orderBy("d", F.col("t") == source).collect()]
        far = up.withColumnRenamed("up", "mid").join(up.select(F.col("t").alias("mid"), "up"), "mid").select("t", "d", "up")
        up = cut(far, "jumps")


def edge_pairs(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """Distances between the ends of the edges of users and points of interest, once for each pair of edges.

    pairs: (u_ni, u_nj, p_ni, p_nj); adds d_ni_ni ... named after the end of the point's edge, then of the user's.  d has the
    distances (s, t, d), or is an index that gives them for the pairs of vertices that occur.
    """
    out = pairs.distinct()
    if hasattr(d, "distances"):
        ends = [out.select(F.col(f"p_{e}").alias("s"), F.col(f"u_{f}").alias("t")) for e in ("ni", "nj") for f in ("ni", "nj")]
        d = cut(d.distances(ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])), "distances")
    for e in ("ni", "nj"):
        for f in ("ni", "nj"):
            one = d.select(F.col("s").alias(f"p_{e}"), F.col("t").alias(f"u_{f}"), F.col("d").alias(f"d_{e}_{f}"))
            out = out.join(one, [f"p_{e}", f"u_{f}"])
    return out


def with_distance(pairs: DataFrame, users: DataFrame, pois: DataFrame, d: DataFrame, exact: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """Pairs (u, p, ...) with the column dist of their road distance.

    Distances are made once for each pair of edges (u_ni, u_nj, p_ni, p_nj) that occurs; `ends` has these (more do no harm)
    where they can be told without making the pairs.
    """
    us = users.select("u", F.col("ni").alias("u_ni"), F.col("nj").alias("u_nj"), F.col("dist").alias("u_len"), F.col("dis").alias("u_dis"))
    ps = pois.select("p", F.col("ni").alias("p_ni"), F.col("nj").alias("p_nj"), F.col("dist").alias("p_len"), F.col("dis").alias("p_dis"))
    by = ["u_ni", "u_nj", "p_ni", "p_nj"]
    rows = pairs.join(us, "u").join(ps, "p")
    rows = rows.join(edge_pairs(rows.select(*by) if ends is None else ends, d), by)
    c = F.col
    by = {(e, f): c(f"d_{e}_{f}") for e in ("ni", "nj") for f in ("ni", "nj")}
    far = place_distance({"ni": c("u_ni"), "nj": c("u_nj"), "dist": c("u_len"), "dis": c("u_dis")}, {"ni": c("p_ni"), "nj": c("p_nj"), "dist": c("p_len"), "dis": c("p_dis")}, by, exact)
    return rows.select(*pairs.columns, far.alias("dist"))


def vertex_place(d: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(v, key, dist): distance of every vertex to every place on an edge."""
    one = d.select(F.col("s").alias("v"), F.col("t").alias("ni"), F.col("d").alias("d1"))
    two = d.select(F.col("s").alias("v"), F.col("t").alias("nj"), F.col("d").alias("d2"))
    rows = places.join(one, "ni").join(two, ["v", "nj"])
    return rows.select("v", key, vertex_offset(F.col("v"), F.col("ni"), F.col("nj"), F.col("dist"), F.col("dis"), F.col("d1"), F.col("d2")).alias("dist"))


def nearest(rows: DataFrame, group: list[str], by: list, k: int) -> DataFrame:
    """The k first rows of each group, numbered from 1 in `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by)).cast("long")).where(F.col("rank") <= k)


def landmark_bounds(d: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(s, t, lower, upper): largest difference and smallest sum of the distances to the landmarks."""
    near = d.join(landmarks.select(F.col("v").alias("s")), "s")
    a, b = near.select(F.col("s").alias("l"), F.col("t").alias("s"), F.col("d").alias("d1")), near.select(F.col("s").alias("l"), "t", F.col("d").alias("d2"))
    return a.join(b, "l").groupBy("s", "t").agg(F.max(F.abs(F.col("d1") - F.col("d2"))).alias("lower"), F.min(F.col("d1") + F.col("d2")).alias("upper"))


def partition(vertices: DataFrame, shift: int = 1) -> DataFrame:
    """(v, leaf): leaves are squares of 2 ** shift units, numbered by Morton code; a prefix of the code is a parent."""
    side = float(1 << shift)
    return vertices.select("v", morton(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).alias("leaf"))


def ancestors(leaves: DataFrame, depth: int = 2) -> DataFrame:
    """(v, level, node): a vertex's nodes from its leaf (level 0) upwards, four children to a node."""
    return leaves.select("v", F.posexplode(F.array(*[F.shiftright("leaf", 2 * i) for i in range(depth + 1)])).alias("level", "node")).select("v", F.col("level").cast("long").alias("level"), "node")


def borders(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """(leaf, v) of vertices with a neighbour in another leaf."""
    roads = both_ways(edges)
    a, b = leaves.select(F.col("v").alias("a"), "leaf"), leaves.select(F.col("v").alias("b"), F.col("leaf").alias("other"))
    return roads.join(a, "a").join(b, "b").where("leaf <> other").select("leaf", F.col("a").alias("v")).distinct()


def leaf_bounds(leaves: DataFrame, edges: DataFrame, d: DataFrame) -> DataFrame:
    """(n1, n2, dmin, dmax) for pairs of leaves: the least distance of their borders, and that plus the largest distances
    of the closest pair of borders to the vertices of their leaves."""
    edge = borders(leaves, edges)
    one, two = edge.select(F.col("leaf").alias("n1"), F.col("v").alias("s")), edge.select(F.col("leaf").alias("n2"), F.col("v").alias("t"))
    close = d.join(one, "s").join(two, "t").where("n1 <> n2").groupBy("n1", "n2").agg(F.min(F.struct("d", "s", "t")).alias("x")).select("n1", "n2", "x.*")
    inside = d.join(leaves.select(F.col("v").alias("s"), F.col("leaf").alias("l1")), "s").join(leaves.select(F.col("v").alias("t"), F.col("leaf").alias("l2")), "t").where("l1 = l2").groupBy("s").agg(F.max("d").alias("far"))
    return close.join(inside.select("s", F.col("far").alias("f1")), "s").join(inside.select(F.col("s").alias("t"), F.col("far").alias("f2")), "t").select("n1", "n2", F.col("d").alias("dmin"), (F.col("d") + F.col("f1") + F.col("f2")).alias("dmax"))


def node_bounds(leaf: DataFrame, shift: int = 1) -> DataFrame:
    """Bounds of leaves rolled up to their parents."""
    up = lambda c: F.shiftright(c, 2 * shift)
    return leaf.groupBy(up("n1").alias("n1"), up("n2").alias("n2")).agg(F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax")).where("n1 <> n2")


def leaf_diameter(leaves: DataFrame, d: DataFrame) -> DataFrame:
    """(leaf, far): largest distance between two vertices of a leaf."""
    one, two = leaves.select(F.col("v").alias("s"), F.col("leaf").alias("l1")), leaves.select(F.col("v").alias("t"), F.col("leaf").alias("l2"))
    return d.join(one, "s").join(two, "t").where("l1 = l2").groupBy(F.col("l1").alias("leaf")).agg(F.max("d").alias("far"))


def first_hops(d: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, t, hop): the neighbour of s that starts a shortest path to t, the smallest of equals."""
    roads = both_ways(edges).select(F.col("a").alias("s"), F.col("b").alias("hop"), F.col("d").alias("len"))
    rest = d.select(F.col("s").alias("hop"), "t", F.col("d").alias("rest"))
    ways = roads.join(rest, "hop").join(d, ["s", "t"]).where("s <> t and abs(len + rest - d) < 1e-9")
    return ways.groupBy("s", "t").agg(F.min("hop").alias("hop"))


def euclid_knn(queries: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(q, v, dist, rank): the k vertices nearest in the plane to each stated query vertex (column v of queries)."""
    q = queries.select(F.col("v").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    rows = q.crossJoin(vertices).where("q <> v").select("q", "v", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")).alias("dist"))
    return nearest(rows, ["q"], ["dist", "v"], k)


def window_rectangle(vertices: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return vertices.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def junction_chains(edges: DataFrame) -> DataFrame:
    """(a, b, end, length): for each way out of a vertex, the next vertex that has not exactly two neighbours, and how far
    it is along the road; a closed ring ends where it began.

    Each way points to the one that follows it; pointers double until they stand still, so a chain of n edges takes about
    log2(n) joins.  What then still runs is a ring without a junction; its length is that of its edges.
    """
    roads = both_ways(edges)
    passed = roads.groupBy("a").agg(F.count("*").alias("deg")).where("deg = 2").select(F.col("a").alias("b"))
    follow = roads.select(F.col("a").alias("b"), F.col("b").alias("y"), F.col("d").alias("more"))
    onward = roads.join(passed, "b").select("a", "b").join(follow, "b").where("y <> a")
    to = roads.join(onward, ["a", "b"], "left").select("a", "b", "d", F.when(F.col("y").isNull(), F.col("a")).otherwise(F.col("b")).alias("x"), F.coalesce("y", "b").alias("y"), F.coalesce("more", F.lit(0.0)).alias("more"), F.col("y").isNull().alias("still"))
    to = cut(to, "chains")
    ends = to.where("still").select(F.col("a").alias("x"), F.col("b").alias("y"))
    n = to.where("not still").count()
    for _ in range(math.ceil(math.log2(n + 1)) if n else 0):
        hop = to.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("more").alias("more2"))
        to = cut(to.join(hop, ["x", "y"]).select("a", "b", "d", F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("more") + F.col("more2")).alias("more"), "still"), "chains")
    done = to.join(ends, ["x", "y"]).select("a", "b", F.col("y").alias("end"), (F.col("d") + F.col("more")).alias("length"))
    ring = to.join(ends, ["x", "y"], "left_anti").select("a", "b", "d")
    if ring.isEmpty():
        return done
    from tidemark.operators.clean import component_labels

    parts = component_labels(ring.select(F.col("a").alias("v")).distinct(), ring.select(F.col("a").alias("ni"), F.col("b").alias("nj")))
    around = ring.join(parts.withColumnRenamed("v", "a"), "a")
    length = around.groupBy("root").agg((F.sum("d") / 2).alias("length"))  # each edge is there in both directions
    return done.unionByName(around.join(length, "root").select("a", "b", F.col("a").alias("end"), "length"))
