"""Keywords: posting lists, weights, relevance, set similarity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geosocial import extended_jaccard
from tidemark.plans.cuts import cut

#: Node similarities go by tiles of so many nodes where there are no more terms than that; results leave in batches of about so many rows.
MOST_TILE_TERMS, TILE, BATCH = 512, 1024, 1 << 17


def term_idf(poi_term: DataFrame, n_pois: int) -> DataFrame:
    """(term, df, idf): idf = log2 of the number of points of interest over those with the term."""
    df = poi_term.distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log2(F.lit(float(n_pois)) / F.col("df")).alias("idf"))


def posting_sizes(user_term: DataFrame, poi_term: DataFrame) -> DataFrame:
    p = poi_term.groupBy("term").agg(F.count("*").alias("n_pois"))
    u = user_term.groupBy("term").agg(F.count("*").alias("n_users"))
    return p.join(u, "term", "full").select("term", F.coalesce("n_pois", F.lit(0)).alias("n_pois"), F.coalesce("n_users", F.lit(0)).alias("n_users"))


def relevance(user_term: DataFrame, poi_term: DataFrame, idf: DataFrame) -> DataFrame:
    """(u, p, rel) of pairs with a common term of positive weight: the sum of the weights of the terms in common.

    Terms that all points of interest have weigh nothing and stay out of the join.  The join is by term, so pairs without
    a common term are never made.
    """
    weighed = poi_term.distinct().join(idf.where("idf > 0").select("term", "idf"), "term")
    return user_term.distinct().join(weighed, "term").groupBy("u", "p").agg(F.sum("idf").alias("rel"))


def group_keywords(poi_term: DataFrame, group: DataFrame) -> DataFrame:
    """Distinct terms of a group of points of interest."""
    return poi_term.join(group, "p", "left_semi").select("term").distinct()


def first_terms(poi_term: DataFrame, most: int) -> DataFrame:
    """(p, terms): the first distinct terms of each point of interest in ascending order."""
    return poi_term.groupBy("p").agg(F.slice(F.array_sort(F.collect_set("term")), 1, most).alias("terms"))


def node_jaccard(counts: DataFrame) -> DataFrame:
    """(n1, n2, sim) for pairs of nodes with a common term: extended Jaccard of their term counts (node, term, cnt), rounded
    to six places.

    With few terms, nodes are dealt to tiles in order, and a task gets pairs of tiles, so nothing is shuffled, summed or
    joined for a pair of nodes.  Else, or where products may not be exact in doubles, it goes by classes of equal nodes.
    """
    nodes = cut(counts.where("node is not null").groupBy("node").agg(F.collect_list(F.struct("term", "cnt")).alias("terms")), "nodes")
    rows = nodes.select("node", F.explode("terms").alias("t")).select("node", "t.*")
    terms = [r["term"] for r in rows.select("term").distinct().limit(MOST_TILE_TERMS + 1).collect()]
    if all(isinstance(counts.schema[c].dataType, T.LongType) for c in ("node", "cnt")) and len(terms) <= MOST_TILE_TERMS and None not in terms:
        m = rows.agg(F.min("cnt").alias("least"), F.max("cnt").alias("most")).first()
        if m["least"] is not None and m["least"] > 0 and m["most"] ** 2 * len(terms) < 1 << 52:  # a sum of two squares is exact, too
            return _by_tiles(nodes, sorted(terms), m["most"])
    return _by_classes(rows)


def _by_tiles(nodes: DataFrame, terms: list, most: int) -> DataFrame:
    """node_jaccard() of nodes (node, terms) by products of whole tiles; most: the largest count."""
    import numpy as np

    at, kind = {t: i for i, t in enumerate(terms)}, np.min_scalar_type(most).str

    def pack(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, TILE):
                part = b.slice(k, TILE)
                node, held = part.column("node").to_numpy(), part.column("terms")
                flat, row = held.flatten(), np.repeat(np.arange(len(node)), held.value_lengths().to_numpy())
                x = np.zeros((len(node), len(at)), kind)
                x[row, [at[t] for t in flat.field("term").to_pylist()]] = flat.field("cnt").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["k", "nodes", "counts"])

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                k1, k2, n1, x, n2, y = (b.column(c)[r].as_py() for c in ("k1", "k2", "n1", "c1", "n2", "c2"))
                n1, n2 = np.frombuffer(n1, "i8"), np.frombuffer(n2, "i8")
                x, y = (np.frombuffer(z, kind).reshape(-1, len(at)).astype("f8") for z in (x, y))
                s1, s2, z = (x * x).sum(1), (y * y).sum(1), np.ascontiguousarray(y.T)
                step = max(1, BATCH // len(n2))
                for i in range(0, len(n1), step):
                    dot = x[i : i + step] @ z
                    left = dot > 0
                    if k1 == k2:
                        left &= n1[i : i + step, None] < n2
                    a, c = np.broadcast_to(n1[i : i + step, None], dot.shape), np.broadcast_to(n2, dot.shape)
                    sim = six_places(dot / (s1[i : i + step, None] + s2 - dot))
                    a, c, sim = (v.reshape(-1) for v in (a, c, sim)) if left.all() else (v[left] for v in (a, c, sim))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(sim)], names=["n1", "n2", "sim"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a tile's nodes are next to each other, so that all of one tile come before all of another
    dealt = nodes.repartitionByRange(max(1, min(n, nodes.count() // (4 * TILE))), "node").sortWithinPartitions("node")
    tiles = cut(dealt.mapInArrow(pack, "k bigint, nodes binary, counts binary"), "tiles")
    first, second = (tiles.select(F.col("k").alias(f"k{i}"), F.col("nodes").alias(f"n{i}"), F.col("counts").alias(f"c{i}")) for i in (1, 2))
    pairs = first.select("k1").join(F.broadcast(second.select("k2")), F.col("k1") <= F.col("k2"))
    return pairs.join(first, "k1").join(second, "k2").repartition(n, "k1", "k2").mapInArrow(run, "n1 bigint, n2 bigint, sim double")


def six_places(x):
    """An array of doubles rounded as by Spark's round(): half up, by the shortest decimal of each."""
    import numpy as np

    y = x * 1e6
    whole = np.floor(y + 0.5)
    for i in np.argwhere(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        i = tuple(i)
        whole[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6))
    return whole / 1e6


def _by_classes(rows: DataFrame) -> DataFrame:
    """node_jaccard() by classes of nodes of equal counts: products are made for pairs of classes and then unfolded, without
    a shuffle of pairs of nodes."""
    kinds = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("term", "cnt"))).alias("terms")).groupBy("terms").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    kinds = cut(kinds.select(F.col("nodes")[0].alias("k"), "nodes", "terms"), "kinds")
    rows = kinds.select("k", F.explode("terms").alias("t")).select("k", F.col("t.term").alias("term"), F.col("t.cnt").alias("cnt"))
    norm = rows.groupBy("k").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("sq"))
    a, b = rows.select(F.col("k").alias("k1"), "term", F.col("cnt").alias("c1")), rows.select(F.col("k").alias("k2"), "term", F.col("cnt").alias("c2"))
    dot = a.join(b, "term").where("k1 <= k2").groupBy("k1", "k2").agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"))
    out = dot.join(norm.select(F.col("k").alias("k1"), F.col("sq").alias("s1")), "k1").join(norm.select(F.col("k").alias("k2"), F.col("sq").alias("s2")), "k2")
    out = cut(out.select("k1", "k2", F.round(extended_jaccard(F.col("dot"), F.col("s1"), F.col("s2")), 6).alias("sim")), "sims")
    out = out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k1", "k2")  # few bytes, but much work
    one, two = kinds.select(F.col("k").alias("k1"), F.col("nodes").alias("x")), kinds.select(F.col("k").alias("k2"), F.col("nodes").alias("y"))
    out = out.join(F.broadcast(one), "k1").join(F.broadcast(two), "k2").select("k1", "k2", "sim", F.explode("x").alias("p"), "y")
    out = out.select("k1", "k2", "sim", "p", F.explode("y").alias("q")).where("k1 <> k2 or p < q")
    return out.select(F.least("p", "q").alias("n1"), F.greatest("p", "q").alias("n2"), "sim")
