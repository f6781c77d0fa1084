"""Text formats of road graphs, places, links and parameters, read with Spark and written as Parquet or text.

All files are white-space separated and without a header.  A term list ends with -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(f, at): the fields of each line that is not empty."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f"))


def _cast(rows: DataFrame, spec: dict[str, tuple[int, str]]) -> DataFrame:
    return rows.select(*[F.get("f", F.lit(i)).try_cast(kind).alias(name) for name, (i, kind) in spec.items()])


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return _cast(_fields(spark, path), {"v": (0, "long"), "x": (1, "double"), "y": (2, "double")})


def read_edges(spark: SparkSession, path: str, with_id: bool = True, most_vertex: int | None = None) -> DataFrame:
    """(eid, ni, nj, dist) with ni < nj; edges with a vertex of most_vertex or more are left out."""
    k = 1 if with_id else 0
    rows = _cast(_fields(spark, path), {"eid": (0 if with_id else 99, "long"), "a": (k, "long"), "b": (k + 1, "long"), "dist": (k + 2, "double")})
    rows = rows.select("eid", F.least("a", "b").alias("ni"), F.greatest("a", "b").alias("nj"), "dist")
    return rows if most_vertex is None else rows.where(F.col("nj") < most_vertex)


def read_places(spark: SparkSession, path: str, key: str = "u") -> DataFrame:
    """(key, ni, nj, dist, dis, terms) of users, places or queries: terms are those before -1."""
    rows = _fields(spark, path)
    tail = F.slice("f", 6, F.greatest(F.size("f") - 5, F.lit(0)))
    end = F.array_position(tail, "-1").cast("int")
    terms = F.when(end > 0, F.slice(tail, F.lit(1), end - 1)).otherwise(tail)
    head = {key: (0, "long"), "ni": (1, "long"), "nj": (2, "long"), "dist": (3, "double"), "dis": (4, "double")}
    return rows.select(*[F.get("f", F.lit(i)).try_cast(kind).alias(n) for n, (i, kind) in head.items()], terms.cast("array<long>").alias("terms"))


def read_friends(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    rows = _cast(_fields(spark, path), {"u": (0, "long"), "v": (1, "long")})
    return rows if most is None else rows.where((F.col("u") < most) & (F.col("v") < most))


def read_checkins(spark: SparkSession, path: str, most_poi: int | None = None, most_user: int | None = None) -> DataFrame:
    rows = _cast(_fields(spark, path), {"p": (0, "long"), "u": (1, "long"), "cnt": (2, "long")})
    if most_poi is not None:
        rows = rows.where(F.col("p") < most_poi)
    return rows if most_user is None else rows.where(F.col("u") < most_user)


def read_pairs(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """Two whole numbers a line: most check-ins of a user, objects on vertices, point pairs."""
    return _cast(_fields(spark, path), {a: (0, "long"), b: (1, "long")})


def read_ids(spark: SparkSession, path: str, key: str = "p") -> DataFrame:
    return _cast(_fields(spark, path), {key: (0, "long")})


def read_weighted(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """(u, v, prob) of a weighted graph: no header line, loops or edges without weight; weights times scale."""
    rows = _fields(spark, path).where(F.size("f") >= 3)
    rows = _cast(rows, {"u": (0, "long"), "v": (1, "long"), "prob": (2, "double")})
    return rows.where("u <> v and prob > 0").withColumn("prob", F.col("prob") * scale)


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    """`key : value` lines; those that start with # are remarks.  A short file."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & F.col("value").contains(":")).limit(10_000).collect()
    return {k.strip(): v.strip() for k, _, v in (r["value"].partition(":") for r in rows)}


def read_dimacs(spark: SparkSession, edges: str, vertices: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a pair of files with lines `v id x y` and `a from to length`."""
    v = _fields(spark, vertices).where(F.get("f", F.lit(0)) == "v")
    e = _fields(spark, edges).where(F.get("f", F.lit(0)) == "a")
    return _cast(v, {"v": (1, "long"), "x": (2, "double"), "y": (3, "double")}), _cast(e, {"ni": (1, "long"), "nj": (2, "long"), "dist": (3, "double")})


def _line(*cols: Column | str) -> Column:
    return F.concat_ws(" ", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value")


def write_lines(df: DataFrame, path: str, *cols: Column | str) -> None:
    df.select(_line(*cols)).write.text(path)


def write_tsv(edges: DataFrame, path: str) -> None:
    edges.select("ni", "nj", "dist").write.csv(path, sep="\t")


def write_ddsg(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Lines `d`, `vertices edges`, then `from to length 0` for each edge, in files that sort in that order."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, "d"), (1, f"{vertices.count()} {edges.count()}")], "at int, value string").coalesce(1).sortWithinPartitions("at").select("value")
    head.write.text(f"{path}/0-head")
    edges.select(_line("ni", "nj", F.col("dist").cast("long"), F.lit(0))).write.text(f"{path}/1-edges")


def write_dimacs(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    both = edges.select("ni", "nj", "dist").unionByName(edges.select(F.col("nj").alias("ni"), F.col("ni").alias("nj"), "dist"))
    both.select(_line(F.lit("a"), "ni", "nj", F.col("dist").cast("long"))).write.text(f"{path}/gr")
    vertices.select(_line(F.lit("v"), "v", F.col("x").cast("long"), F.col("y").cast("long"))).write.text(f"{path}/co")


def write_by_leaf(rows: DataFrame, path: str, leaf: str = "leaf", key: str = "id") -> None:
    """Rows of one partition-tree leaf next to each other: filters on the leaf or key skip the other row groups."""
    rows.repartitionByRange(leaf, key).sortWithinPartitions(leaf, key).write.parquet(path)


def inverted_index(places: DataFrame, key: str) -> DataFrame:
    """(term, key) from places with a list of terms, each once."""
    return places.select(key, F.explode("terms").alias("term")).distinct()


def on_graph(places: DataFrame, edges: DataFrame, n_vertices: int) -> DataFrame:
    """Places put on a cleaned graph: ends beyond its vertices are taken modulo their number with the smallest neighbour
    there; elsewhere the edge's length holds, and an offset beyond it is cut."""
    ends = edges.select("ni", "nj", F.col("dist").alias("len"))
    near = ends.select(F.col("ni").alias("a"), F.col("nj").alias("b"), "len").unionByName(ends.select(F.col("nj").alias("a"), F.col("ni").alias("b"), "len")).groupBy("a").agg(F.min(F.struct("b", "len")).alias("to"))
    out = (F.col("ni") >= n_vertices) | (F.col("nj") >= n_vertices)
    moved = places.where(out).withColumn("a", F.col("ni") % n_vertices).join(near, "a")
    rest = [c for c in places.columns if c not in ("ni", "nj", "dist", "dis")]
    moved = moved.select(*rest, F.least("a", "to.b").alias("ni"), F.greatest("a", "to.b").alias("nj"), F.col("to.len").alias("dist"), F.least("dis", "to.len").alias("dis"))
    kept = places.where(~out).join(ends, ["ni", "nj"]).select(*rest, "ni", "nj", F.col("len").alias("dist"), F.least("dis", "len").alias("dis"))
    return kept.unionByName(moved)
