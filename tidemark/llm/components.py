"""Connected components of links that are spread over the cluster, and their local part inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) that join the same nodes as the links a-b do; roots are left out."""
    if not len(a):
        return a, b
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node that its links reach.

    Each round hooks every node to its smallest neighbour, shortens these hooks twice, and contracts the links to the
    hooks' ends; a path of any length thus shrinks by a constant factor a round.  All tables stay distributed and each
    round is cut in the shared folder.  Links with a null end are ignored; repeated links and loops do no harm; no
    links give no rows.
    """
    spark = links.sparkSession
    rest = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    roots = None
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(hook.join(over, "up").select("node", F.col("top").alias("up")), "hooks")
            drop_cut(hook)
            hook = jumped
        one, two = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        smaller = rest.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        smaller = cut(smaller, "links")
        if roots is None:
            joined = hook.select("node", F.col("up").alias("root"))
            roots = cut(joined, "roots")
        else:
            lift = hook.select(F.col("node").alias("root"), F.col("up").alias("top"))
            longer = cut(roots.join(lift, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            drop_cut(roots)
            roots = longer
        drop_cut(hook)
        drop_cut(rest)
        rest = smaller
    else:
        raise RuntimeError(f"links still open after {most_rounds} rounds")
    if roots is None:
        kind = rest.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return roots
