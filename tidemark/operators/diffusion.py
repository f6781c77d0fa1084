"""Diffusion over friendships: edge probabilities, live edges, reachability, reverse-reachable sets, spread.

Every edge is drawn once for each round by a hash of (seed, round, u, v), so a cascade is reachability among live edges
and any engine gets the same draws.  Rounds are a column: all of them advance together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geosocial import draw
from tidemark.plans.cuts import cut


#: With so many nodes to go on from or fewer, a job of reach() goes more steps.
FEW = 1 << 16


def edge_probability(links: DataFrame, mode: str = "wc", p: float = 0.1, seed: int = 1) -> DataFrame:
    """(u, v, prob): weighted cascade (one over the degree of v), uniform, or trivalency (0.001, 0.01 or 0.1 by a hash)."""
    if mode == "wc":
        deg = links.groupBy("v").agg(F.count("*").alias("deg"))
        return links.join(deg, "v").select("u", "v", (F.lit(1.0) / F.col("deg")).alias("prob"))
    if mode == "uniform":
        return links.select("u", "v", F.lit(float(p)).alias("prob"))
    if mode == "trivalency":
        which = draw(F.col("u"), F.col("v"), seed=seed) % 3
        return links.select("u", "v", F.when(which == 0, 0.001).when(which == 1, 0.01).otherwise(0.1).alias("prob"))
    raise ValueError(f"unknown mode {mode}")


def is_live(round_: Column, u: Column, v: Column, prob: Column, seed: int = 1) -> Column:
    return (draw(round_, u, v, seed=seed) % 1001) / 1000 <= prob


def live_edges(edges: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """(round, u, v) of the edges that are live in each of the rounds 0, 1, ..."""
    each = edges.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<bigint>")))
    return each.where(is_live(F.col("round"), F.col("u"), F.col("v"), F.col("prob"), seed)).select("round", "u", "v")


def reach(starts: DataFrame, edges: DataFrame, group: tuple[str, ...] = ("round",), live=None, hops: int = 3, far: int = 12) -> DataFrame:
    """(*group, node, depth) of everything that edges (u, v, and any group columns) reach from the starts (*group, node),
    by breadth.

    Edges without a group column serve all its values; `live`, a condition on (group, u, v, prob), draws them when they are
    first looked at, so that no table of all rounds' live edges is made.  A job goes `hops` steps on, and `far` once few are
    left to go on from, so that its fixed cost is paid once for these; only what the last of them found goes on from there.
    Each step is one join with lists of neighbours, which keeps what is found already beside what is new.  A cycle ends, as
    no node is visited twice, and the search goes on until nothing new is found.
    """
    keys = [*group, "node"]
    on = [g for g in group if g in edges.columns]
    rest = [c for c in edges.columns if c not in (*on, "u")]
    next_ = cut(edges.groupBy(*on, "u").agg(F.collect_list(F.struct(*rest)).alias("next")), "next")
    none = F.array().cast(next_.schema["next"].dataType)
    stay = F.array(F.lit(None).cast(next_.schema["next"].dataType.elementType))  # a null stands for the node itself
    seen = cut(starts.select(*keys, F.lit(0).cast("long").alias("depth")).distinct(), "reach")
    frontier, depth, parts = seen, 0, 0
    few = frontier.count() <= FEW
    while True:
        found, steps = frontier, far if few else hops
        for i in range(depth, depth + steps):
            open_ = F.when(F.col("depth") == i, F.coalesce("next", none)).otherwise(none)
            found = found.withColumnRenamed("node", "u").join(next_, [*on, "u"], "left")
            found = found.select(*group, "u", "depth", F.explode(F.concat(stay, open_)).alias("to")).select(*group, "u", "depth", "to", "to.*")
            found = found if live is None else found.where(F.col("to").isNull() | live)
            to = F.when(F.col("to").isNull(), F.struct(F.col("u").alias("node"), "depth")).otherwise(F.struct(F.col("v").alias("node"), F.lit(i + 1).cast("long").alias("depth")))
            found = found.select(*group, to.alias("to")).groupBy(*group, F.col("to.node").alias("node")).agg(F.min("to.depth").alias("depth"))
        new = cut(found.where(F.col("depth") > depth).join(seen.select(*keys), keys, "left_anti").select(*keys, "depth"), "reach")
        if new.isEmpty():
            return seen
        depth, parts, seen = depth + steps, parts + 1, seen.unionByName(new)
        frontier = new.where(F.col("depth") == depth)
        few = few or frontier.count() <= FEW
        if parts % 8 == 0:
            seen = cut(seen, "reach")


def rr_roots(spark, count: int, n_users: int, seed: int = 1, first: int = 0) -> DataFrame:
    """(round, node): a root for each reverse-reachable set, uniform over users 0 to n_users - 1 by a hash."""
    r = spark.range(first, first + count).withColumnRenamed("id", "round")
    return r.select("round", (draw(F.lit("root"), F.col("round"), seed=seed) % n_users).alias("node"))


def rr_users(edges: DataFrame, roots: DataFrame, seed: int = 1) -> DataFrame:
    """(round, node, depth): users who reach each set's root over live edges."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "prob")
    return reach(roots, back, live=is_live(F.col("round"), F.col("v"), F.col("u"), F.col("prob"), seed))


def rr_pois(sets: DataFrame, seeds: DataFrame, least_depth: int = 0) -> DataFrame:
    """(round, p): places attached (p, u) to any user of a set at this depth or deeper; each place once."""
    return sets.where(F.col("depth") >= least_depth).join(seeds.select("p", F.col("u").alias("node")), "node").select("round", "p").distinct()


def spread_ic(edges: DataFrame, seeds: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """(spread): users active at the end of independent cascades from seeds (column u), on average over the rounds."""
    starts = seeds.select(F.col("u").alias("node")).distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<bigint>")))
    active = reach(starts.select("round", "node"), edges, live=is_live(F.col("round"), F.col("u"), F.col("v"), F.col("prob"), seed))
    return active.agg((F.count("*") / rounds).alias("spread"))


def spread_lt(edges: DataFrame, seeds: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """(spread) of linear thresholds: a user turns active when the summed probabilities of active friends reach a
    threshold drawn for each round and user."""
    active = cut(seeds.select(F.col("u").alias("node")).distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<bigint>"))).select("round", "node"), "active")
    while True:  # every step but the last turns a user on
        pull = active.withColumnRenamed("node", "u").join(edges, "u").groupBy("round", F.col("v").alias("node")).agg(F.sum("prob").alias("pull"))
        turned = pull.where(F.round("pull", 9) >= (draw(F.lit("lt"), F.col("round"), F.col("node"), seed=seed) % 1001) / 1000).select("round", "node")
        turned = cut(turned.join(active, ["round", "node"], "left_anti"), "active")
        if turned.isEmpty():
            return active.agg((F.count("*") / rounds).alias("spread"))
        active = cut(active.unionByName(turned), "active")


def one_hop(links: DataFrame, edges: DataFrame, exclude_seeds: bool = False) -> DataFrame:
    """(p, spread): seeds of each place, and for each friend of theirs the chance that a live edge reaches it.

    links: (p, u).  A seed that is another seed's friend counts again unless exclude_seeds.
    """
    seeds = links.select("p", "u").distinct()
    miss = F.when(F.max("prob") >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.least("prob", F.lit(1 - 1e-15))))))
    hop = seeds.join(edges, "u").groupBy("p", "v").agg(miss.alias("chance"))
    if exclude_seeds:
        hop = hop.join(seeds.withColumnRenamed("u", "v"), ["p", "v"], "left_anti")
    gain = hop.groupBy("p").agg(F.sum("chance").alias("gain"))
    own = seeds.groupBy("p").agg(F.count("*").alias("n"))
    return own.join(gain, "p", "left").select("p", (F.col("n") + F.coalesce("gain", F.lit(0.0))).alias("spread"))
