"""Choice of a few places: greedy covers over sampled sets, sampling that stops by bounds, and simple rankings.

The number of chosen places is small, so a step of a greedy choice is one grouped count over the sampled sets; what
reaches the driver is a row, or the largest gains.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geosocial import draw
from tidemark.operators.diffusion import is_live, one_hop, reach, rr_pois, rr_roots, rr_users
from tidemark.plans.cuts import cut


@dataclass
class Choice:
    """Chosen places in order, with the gain of each, and what the method found out about them."""

    pois: list[int] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)
    facts: dict = field(default_factory=dict)

    def frame(self, spark, *facts: str) -> DataFrame:
        """(step, p, gain), and the named facts (null where the method has none), the same in every row."""
        more = [None if self.facts.get(f) is None else float(self.facts[f]) for f in facts]
        rows = [(i, p, float(g), *more) for i, (p, g) in enumerate(zip(self.pois, self.gains), 1)]
        return spark.createDataFrame(rows, ", ".join(["step long, p long, gain double", *(f"{f} double" for f in facts)]))


def greedy_cover(sets: DataFrame, b: int, item: str = "p") -> Choice:
    """Items that cover the most sets (round, item), one after the other; ties by number.

    facts["upper"] bounds the cover of any b items: the least over the steps of what is covered plus the b largest gains.
    """
    out, left, upper = Choice(), sets.select("round", item), math.inf
    covered = 0
    for step in range(b + 1):
        top = left.groupBy(item).agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), item).limit(b).collect()
        upper = min(upper, covered + sum(r["gain"] for r in top))
        if step == b or not top:
            break
        best = top[0]
        out.pois.append(best[item])
        out.gains.append(best["gain"])
        covered += best["gain"]
        left = cut(left.join(left.where(F.col(item) == best[item]).select("round").distinct(), "round", "left_anti"), "cover")
    out.facts |= {"covered": covered, "upper": upper}
    return out


def covered_sets(sets: DataFrame, items: list[int], item: str = "p") -> int:
    return sets.where(F.col(item).isin(items)).select("round").distinct().count()


def greedy_one_hop(links: DataFrame, edges: DataFrame, b: int) -> Choice:
    """Places by the one-hop spread of the union of their users, one after the other.

    What the chosen users leave of each friend's chance not to be reached is kept and multiplied on, so that a step looks
    at each place's own new users only: its gain is their number, and of every friend of theirs the part of that rest
    that they take.
    """
    out = Choice()
    links = cut(links.select("p", "u").distinct(), "links")
    edges = edges.select("u", "v", "prob")
    miss = F.when(F.max("prob") >= 1, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.least("prob", F.lit(1 - 1e-15))))))
    rest, left, value = links, None, 0.0
    for _ in range(b):
        hop = rest.join(edges, "u").groupBy("p", "v").agg(miss.alias("m"))
        if left is not None:
            hop = hop.join(left, "v", "left")
        free = F.lit(1.0) if left is None else F.coalesce("left", F.lit(1.0))
        gain = hop.groupBy("p").agg(F.sum(free * (1 - F.col("m"))).alias("gain"))
        own = rest.groupBy("p").agg(F.count("*").alias("n"))
        total = own.join(gain, "p", "left").select("p", (F.col("n") + F.coalesce("gain", F.lit(0.0))).alias("gain"))
        rows = links.select("p").distinct().join(total, "p", "left").select("p", F.coalesce("gain", F.lit(0.0)).alias("gain"))
        best = (rows.where(~F.col("p").isin(out.pois)) if out.pois else rows).orderBy(F.desc(F.round("gain", 9)), "p").first()
        if best is None:
            break
        mine = rest.where(F.col("p") == best["p"]).select("u")
        taken = mine.join(edges, "u").groupBy("v").agg(miss.alias("m"))
        if left is None:
            left = cut(taken.select("v", F.col("m").alias("left")), "left")
        else:
            left = cut(left.join(taken, "v", "full").select("v", (F.coalesce("left", F.lit(1.0)) * F.coalesce("m", F.lit(1.0))).alias("left")), "left")
        out.pois.append(best["p"])
        out.gains.append(best["gain"])
        value += best["gain"]
        rest = cut(rest.where(F.col("p") != best["p"]).join(mine, "u", "left_anti").select("p", "u"), "links")
    out.facts["spread"] = value
    return out


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


JUDGE = 1 << 40  # rounds from here on are the second family of sets
LEAST_SETS, AHEAD = 4096, 4  # a search makes this many sets, or this many times those that are there


class Sampler:
    """Reverse-reachable sets of places, made once and kept: asking for more sets samples only the missing ones.

    With two families their sets, independent of each other, are searched for in the same steps.  A search has as many steps
    for few sets as for many, so it makes some ahead; a set depends on its number alone, and only those asked for are given.
    """

    def __init__(self, spark, edges: DataFrame, links: DataFrame, n_users: int, seed: int, least_depth: int = 0, families: int = 1):
        self.spark, self.edges, self.links, self.n, self.seed, self.depth = spark, edges, links, n_users, seed, least_depth
        self.made, self.asked, self.parts, self.firsts = 0, 0, None, [0, JUDGE][:families]

    def sets(self, count: int) -> DataFrame:
        self.asked = max(self.asked, count)
        if count > self.made:
            upto = max(count, AHEAD * self.made, LEAST_SETS)
            more = [rr_roots(self.spark, upto - self.made, self.n, self.seed, f + self.made) for f in self.firsts]
            roots = more[0] if len(more) == 1 else more[0].unionByName(more[1])
            new = cut(rr_pois(rr_users(self.edges, roots, self.seed), self.links, self.depth), "sets")
            self.parts = new if self.parts is None else self.parts.unionByName(new)
            self.made = upto
        return self.parts if count == self.made else self.parts.where(F.col("round") % JUDGE < count)


def opimc(spark, edges: DataFrame, links: DataFrame, n_users: int, n_pois: int, b: int, epsilon: float = 0.1, delta: float | None = None, local: DataFrame | None = None) -> Choice:
    """Sampling in doubling rounds: choose on one half of the sets, judge on the other, stop when the ratio of the bounds
    passes 1 - 1/e - epsilon.

    local: with (p, spread) of one hop, the outer sets (users two or more hops away) are sampled and the local part is
    exact (the hybrid method).  facts tell the sets of each half, the ratio of the bounds that was reached, and the estimate.
    """
    e1, delta = 1 - 1 / math.e, delta or 1 / (2 * n_users)
    x, y = math.sqrt(math.log(6 / delta)), math.sqrt(e1 * (_log_choose(n_pois, b) + math.log(6 / delta)))
    base = max(1, math.ceil(2 * (e1 * x + y) ** 2))
    most = 2 * n_users * (e1 * x + y) ** 2 / ((1 if local is not None else b) * epsilon**2) + 1
    rounds = max(1, math.ceil(math.log2(most / base)) + 1)
    a = math.log(3 * rounds / delta)
    depth = 2 if local is not None else 0
    sampler = Sampler(spark, edges, links, n_users, 11, depth, families=2)
    count, out = base, Choice()
    for i in range(rounds):
        both = sampler.sets(count)
        one, two = both.where(F.col("round") < JUDGE), both.where(F.col("round") >= JUDGE)
        out = greedy_cover(one, b) if local is None else _hybrid_cover(one, local, b, n_users / count)
        cov, up = covered_sets(two, out.pois), out.facts["upper"]
        low_n = (math.sqrt(cov + 2 * a / 9) - math.sqrt(a / 2)) ** 2 - a / 18
        up_n = (math.sqrt(up + a / 2) + math.sqrt(a / 2)) ** 2
        extra = out.facts.get("local", 0.0) * count / n_users
        ratio = (max(low_n, 0.0) + extra) / (up_n + extra)
        out.facts |= {"sets": count, "ratio": ratio, "rounds": i + 1, "estimate": cov * n_users / count + out.facts.get("local", 0.0)}
        if ratio > e1 - epsilon or count >= most:
            break
        count *= 2
    return out


def _hybrid_cover(sets: DataFrame, local: DataFrame, b: int, scale: float) -> Choice:
    out, left, covered, value = Choice(), sets.select("round", "p"), 0, 0.0
    for _ in range(b):
        outer = left.groupBy("p").agg(F.count("*").alias("n"))
        rows = local.join(outer, "p", "left").where(~F.col("p").isin(out.pois)) if out.pois else local.join(outer, "p", "left")
        rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("gain", F.col("spread") + F.col("n") * scale)
        best = rows.orderBy(F.desc(F.round("gain", 9)), "p").first()
        if best is None:
            break
        out.pois.append(best["p"])
        out.gains.append(best["gain"])
        covered, value = covered + best["n"], value + best["spread"]
        left = cut(left.join(left.where(F.col("p") == best["p"]).select("round").distinct(), "round", "left_anti"), "cover")
    out.facts |= {"covered": covered, "upper": covered + sum(r["n"] for r in left.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(b).collect()), "local": value}
    return out


def imm(spark, edges: DataFrame, links: DataFrame, n_users: int, n_pois: int, b: int, epsilon: float = 0.1, ell: float = 1.0) -> Choice:
    """Two phases: halve a guess of the best spread until sampled cover confirms it, then sample as many sets as that
    lower bound asks for and choose on them."""
    log_n, choose = math.log(max(2, n_users)), _log_choose(n_pois, b)
    ell = ell * (1 + math.log(2) / log_n)
    e2 = math.sqrt(2) * epsilon
    lam = (2 + 2 / 3 * e2) * (choose + ell * log_n + math.log(max(2.0, math.log2(max(2, n_users))))) * n_users / e2**2
    sampler, low, out = Sampler(spark, edges, links, n_users, 37), 1.0, Choice()
    for i in range(1, max(2, int(math.log2(max(2, n_users))))):
        guess = n_users / 2**i
        count = math.ceil(lam / guess)
        out = greedy_cover(sampler.sets(count), b)
        found = n_users * out.facts["covered"] / count
        if found >= (1 + e2) * guess:
            low = max(1.0, found / (1 + e2))
            break
    e1 = 1 - 1 / math.e
    alpha, beta = math.sqrt(ell * log_n + math.log(2)), math.sqrt(e1 * (choose + ell * log_n + math.log(2)))
    count = max(sampler.asked, math.ceil(2 * n_users * (e1 * alpha + beta) ** 2 / epsilon**2 / low))
    out = greedy_cover(sampler.sets(count), b)
    out.facts |= {"sets": count, "low": low, "estimate": n_users * out.facts["covered"] / count}
    return out


def _rounds(count: int):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))


def pmc(spark, edges: DataFrame, links: DataFrame, b: int, graphs: int = 200, seed: int = 5) -> Choice:
    """Greedy over whole live-edge graphs: a place's gain is the number of users, not yet reached, that its users reach."""
    starts = links.select("p", F.col("u").alias("node")).distinct().withColumn("round", _rounds(graphs))
    each = reach(starts, edges, ("p", "round"), is_live(F.col("round"), F.col("u"), F.col("v"), F.col("prob"), seed))
    out, left = Choice(), each.select("p", "round", "node")
    for _ in range(b):
        best = left.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").first()
        if best is None:
            break
        out.pois.append(best["p"])
        out.gains.append(best["n"] / graphs)
        left = cut(left.join(left.where(F.col("p") == best["p"]).select("round", "node"), ["round", "node"], "left_anti"), "left")
    out.facts["estimate"] = sum(out.gains)
    return out


def celf(spark, edges: DataFrame, links: DataFrame, b: int, rounds: int = 10_000, seed: int = 7) -> Choice:
    """Lazy greedy by simulated spread: gains of earlier steps bound later ones, so only the top is simulated again.

    The first step simulates all candidates in one search, place and round being columns; what each place alone reaches in
    a round is kept, and since a set of places reaches what they reach one by one in the same draws, a later gain is a
    count of what is new.  With the best one the runner-up given that it is chosen is counted too, so that a place whose
    runner-up was the last chosen one needs no new count.
    """
    starts = links.select("p", F.col("u").alias("node")).distinct().withColumn("round", _rounds(rounds))
    left = reach(starts, edges, ("p", "round"), is_live(F.col("round"), F.col("u"), F.col("v"), F.col("prob"), seed)).select("p", "round", "node")
    bound = {r["p"]: r["n"] / rounds for r in left.groupBy("p").agg(F.count("*").alias("n")).collect()}  # the candidates of a query
    out, fresh = Choice(), {p: 0 for p in bound}
    ahead: dict[int, tuple[int, float]] = {}  # of a place: the chosen one that its next gain supposes, and that gain
    for step in range(b):
        if not bound:
            break
        while True:
            top = min(bound, key=lambda x: (-round(bound[x], 9), x))
            if fresh[top] == step:
                break
            if ahead.get(top, (None, 0.0))[0] == (out.pois or [None])[-1] and fresh[top] == step - 1:
                bound[top] = ahead[top][1]
            else:
                stale = [p for p in sorted(bound, key=lambda x: (-bound[x], x)) if fresh[p] < step][:8]
                got = {r["p"]: r["n"] / rounds for r in left.where(F.col("p").isin(stale)).groupBy("p").agg(F.count("*").alias("n")).collect()}
                bound |= {p: got.get(p, 0.0) for p in stale}
                fresh |= {p: step for p in stale}
            fresh[top] = step
        out.pois.append(top)
        out.gains.append(bound.pop(top))
        if step + 1 < b and bound:
            taken = left.where(F.col("p") == top).select("round", "node")
            second = min(bound, key=lambda x: (-round(bound[x], 9), x))
            left = cut(left.where(F.col("p") != top).join(taken, ["round", "node"], "left_anti"), "left")
            ahead[second] = top, left.where(F.col("p") == second).count() / rounds
    out.facts["estimate"] = sum(out.gains)
    return out


def heuristic(reverse: DataFrame, edges: DataFrame, b: int, step: float = 0.04, enough: float = 0.9) -> Choice:
    """Users in order of their one-hop pull are let in by steps of a share; places are chosen on those let in, until
    their spread is close to a bound from all."""
    links = cut(reverse.select("p", "u").distinct(), "links")
    pull = edges.groupBy("u").agg(F.sum("prob").alias("pull"))
    ranked = links.select("u").distinct().join(pull, "u", "left").withColumn("pull", F.coalesce("pull", F.lit(0.0)))
    shares = [min(1.0, step * 2**i) for i in range(12)]
    limits = ranked.agg(F.percentile_approx("pull", F.array(*[F.lit(1 - s) for s in shares]), 10_000).alias("q")).first()["q"] or []
    top = one_hop(links, edges).orderBy(F.desc("spread")).limit(b).agg(F.sum("spread")).first()[0] or 0.0
    out = Choice()
    for share, limit in zip(shares, limits):
        out = greedy_one_hop(links.join(ranked.where(F.col("pull") >= limit).select("u"), "u", "left_semi"), edges, b)
        if share >= 1 or (top and out.facts["spread"] >= enough * top):
            break
    out.facts["share"] = share if limits else 0.0
    return out


def by_cardinality(reverse: DataFrame, b: int) -> DataFrame:
    """(p, n): places with the most users in their reverse result."""
    return reverse.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(b)


def by_relevance(pairs: DataFrame, b: int, within: float = 10_000.0) -> DataFrame:
    """(p, n): places with the most users who share a term within a distance; pairs: (u, p, rel, dist)."""
    near = pairs.where((F.col("rel") > 0) & (F.col("dist") < within))
    return near.groupBy("p").agg(F.countDistinct("u").alias("n")).orderBy(F.desc("n"), "p").limit(b)


def by_influencers(reverse: DataFrame, edges: DataFrame, b: int, top: int = 201) -> DataFrame:
    """(p, n): places with the most of the `top` users of largest pull."""
    pull = edges.groupBy("u").agg(F.sum("prob").alias("pull"))
    best = reverse.select("u").distinct().join(pull, "u").orderBy(F.desc(F.round("pull", 9)), "u").limit(top).select("u")
    return by_cardinality(reverse.join(best, "u", "left_semi"), b)


def by_chance(pois: DataFrame, b: int, seed: int = 1) -> DataFrame:
    """(p): places in order of a hash, none twice."""
    return pois.select("p").orderBy(draw(F.lit("poi"), F.col("p"), seed=seed), "p").limit(b)


def reachable_users(links: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): users whom the attached users reach over any edges."""
    return reach(links.select(F.col("u").alias("node")), edges.select("u", "v"), group=())
