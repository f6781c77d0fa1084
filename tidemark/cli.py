"""Choices of places from the command line: python -m tidemark.cli FOLDER --algorithm appro --k 20 ...

FOLDER holds the driver's tables, or with --files NAME the text files NAME.cnode, NAME.cedge and so on."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators.border_index import border_index
from tidemark.operators import diffusion, ranking, road, selection
from tidemark.plans.cuts import cut
from tidemark.sources.files import TextDomain
from tidemark.sources.fixtures import Domain

# The settings that sweeps take.
K, ALPHAS, BUDGETS, EPSILONS = (10, 15, 20, 25, 30), (0.0, 0.2, 0.4, 0.6, 0.8), (1, 3, 5, 7, 9), (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
ALGORITHMS = ("base", "appro", "heuris", "onehop", "twohop", "rele", "cardi", "influ", "random", "imm", "celf", "pmc")


def choose(domain: Domain | TextDomain, algorithm: str, k: int, alpha: float, b: int, epsilon: float, candidates: int, distances=None) -> selection.Choice:
    """Places chosen out of the first `candidates` by one of ALGORITHMS; distances: of all pairs, or an index."""
    spark = domain.spark
    ask = domain.pois.select("p").where(F.col("p") < candidates)
    scores = ranking.Scores(domain, road.apsp(domain.road_vertex, domain.road_edge) if distances is None else distances, alpha=alpha)
    if algorithm == "random":
        return selection.Choice([r["p"] for r in selection.by_chance(ask, b).collect()])
    if algorithm == "rele":
        near = road.with_distance(scores.relevant().join(ask, "p", "left_semi"), domain.users, domain.pois, scores.d)
        return _ranked(selection.by_relevance(near, b))
    edges = cut(diffusion.edge_probability(domain.friend_und), "edges")
    reverse = cut(ranking.reverse_topk(scores.scored(), ask, k).select("p", "u"), "reverse")
    if algorithm == "cardi":
        return _ranked(selection.by_cardinality(reverse, b))
    if algorithm == "influ":
        return _ranked(selection.by_influencers(reverse, edges, b))
    if algorithm == "heuris":
        return selection.heuristic(reverse, edges, b)
    if algorithm == "onehop":
        return selection.greedy_one_hop(reverse, edges, b)
    if algorithm == "celf":
        return selection.celf(spark, edges, reverse, b)
    if algorithm == "pmc":
        return selection.pmc(spark, edges, reverse, b)
    if algorithm == "imm":
        return selection.imm(spark, edges, reverse, domain.n_users, candidates, b, epsilon)
    local = cut(diffusion.one_hop(reverse, edges), "local") if algorithm in ("appro", "twohop") else None
    return selection.opimc(spark, edges, reverse, domain.n_users, candidates, b, epsilon, local=local)


def _ranked(rows) -> selection.Choice:
    got = rows.collect()
    return selection.Choice([r["p"] for r in got], [float(r["n"]) for r in got])


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("folder")
    a.add_argument("--algorithm", choices=ALGORITHMS, default="appro")
    a.add_argument("--k", type=int, default=20)
    a.add_argument("--alpha", type=float, default=0.6)
    a.add_argument("--budget", type=int, default=5)
    a.add_argument("--epsilon", type=float, default=0.1)
    a.add_argument("--candidates", type=int, default=200)
    a.add_argument("--files", metavar="NAME")
    a.add_argument("--leaf", type=int, help="side of the index's leaves, a power of two; without it all pairs of vertices")
    o = a.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    domain = TextDomain(spark, o.folder, o.files, o.k) if o.files else Domain(spark, o.folder)
    index = border_index(domain.road_vertex, domain.road_edge, o.leaf.bit_length() - 1) if o.leaf else None
    got = choose(domain, o.algorithm, o.k, o.alpha, o.budget, o.epsilon, o.candidates, index)
    print(json.dumps({"pois": got.pois, "gains": got.gains, "facts": got.facts, "seconds": round(time.time() - began, 2)}))


if __name__ == "__main__":
    main()
