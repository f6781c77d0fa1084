"""Cleaning of raw road graphs, links and keyword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.cuts import cut


def dedup_undirected(edges: DataFrame) -> DataFrame:
    """(ni, nj, dist) with ni < nj: no loops, no negative lengths, and of parallel edges the shortest."""
    return edges.where("ni <> nj and dist >= 0").groupBy(F.least("ni", "nj").alias("ni"), F.greatest("ni", "nj").alias("nj")).agg(F.min("dist").alias("dist"))


def euclid_floor(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with lengths raised to the length in the plane, rounded up, where they are below it."""
    a, b = vertices.select(F.col("v").alias("ni"), F.col("x").alias("x1"), F.col("y").alias("y1")), vertices.select(F.col("v").alias("nj"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    line = F.ceil(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))).cast("double")
    return edges.join(a, "ni").join(b, "nj").select("ni", "nj", F.greatest(F.col("dist"), line).alias("dist"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("ni").alias("v")).unionByName(edges.select(F.col("nj").alias("v")))
    return ends.groupBy("v").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def duplicate_coordinates(vertices: DataFrame) -> DataFrame:
    """Vertices at a place that one with a smaller number has."""
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("v"))
    return vertices.withColumn("rank", rank).where("rank > 1").select("v")


def drop_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = vertices.join(gone, "v", "left_anti")
    cut_ = edges.join(gone.select(F.col("v").alias("ni")), "ni", "left_anti").join(gone.select(F.col("v").alias("nj")), "nj", "left_anti")
    return left, cut_


def drop_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("ni").alias("v")).unionByName(edges.select(F.col("nj").alias("v")))
    return vertices.join(ends, "v", "left_semi")


def component_labels(vertices: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(v, root): smallest vertex of each one's component, by hooking to the smallest neighbour and contracting."""
    roots = cut(vertices.select("v", F.col("v").alias("root")), "roots")
    rest = cut(edges.select(F.col("ni").alias("a"), F.col("nj").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        if rest.isEmpty():
            return roots
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = cut(hook.join(over, "up").select("node", F.col("top").alias("up")), "hooks")
        x, y = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        rest = cut(rest.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        roots = cut(roots.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select("v", F.coalesce("up", "root").alias("root")), "roots")
    raise RuntimeError("components still open")


def largest_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices of the largest component; of equals, all of them."""
    roots = component_labels(vertices, edges)
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    top = size.agg(F.max("n").alias("n"))
    return roots.join(size.join(top, "n").select("root"), "root", "left_semi").select("v")


def dense_ids(rows: DataFrame, key: str, order: list, name: str = "id") -> DataFrame:
    """rows with numbers from 0 in a total order, without bringing them into one task.

    Rows are sorted into ranges, each range is counted, and numbers start where the ranges before end.  The driver sees
    one count for each range.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    at, starts = 0, {}
    for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        starts[r["__part"]], at = at, at + r["n"]
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("__part"))
    local = F.col("__at") - F.shiftleft(F.shiftright("__at", 33), 33)
    return ranged.withColumn(name, (base + local).cast("long")).drop("__part", "__at")


def term_rank_by_df(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, df, rank): terms numbered from 1 by falling document frequency, ties by term."""
    df = terms.groupBy(term).agg(F.count("*").alias("df"))
    return dense_ids(df, term, [F.desc("df"), F.asc(term)], "rank").withColumn("rank", F.col("rank") + 1)


def cap_ids(links: DataFrame, a: str, b: str, most: int) -> DataFrame:
    return links.where((F.col(a) < most) & (F.col(b) < most))


def pseudo_diameter(edges: DataFrame, start: int, rounds: int = 3) -> float:
    """Largest distance found by going to the farthest vertex (ties: smaller degree, then number) again and again."""
    from tidemark.operators.road import both_ways, sssp

    degree = both_ways(edges).groupBy(F.col("a").alias("t")).agg(F.count("*").alias("deg"))
    far, at = -1.0, start
    for _ in range(rounds):
        source = edges.sparkSession.createDataFrame([(at,)], "s long")
        row = sssp(edges, source).join(degree, "t").orderBy(F.desc("d"), "deg", "t").first()
        if row is None or row["d"] <= far:
            break
        far, at = row["d"], row["t"]
    return far


def coordinate_ranges(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
