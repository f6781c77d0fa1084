"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Each vector is scaled to length one and rounded to int8 steps, and what that took away is rounded to finer int8 steps; the
length of what is then left bounds how far any product with it can be off.  Tiles of rounded vectors travel, not doubles.
Their coarse values are multiplied exactly; a pair is linked if even the lowest possible cosine reaches the threshold and
dropped if the highest does not.  Of the pairs between, the fine values decide nearly all in the same way, and only what
these leave open too is fetched and computed in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import components, local_forest

_EPS = 1e-12  # more than rounding in double precision can move a sum of bounded products


@dataclass
class Tile:
    """Rows of length one as int8 values, their steps, and the lengths of the rounding errors; of the coarse values, and of
    coarse and fine ones together."""

    coarse: np.ndarray
    step: np.ndarray
    error: np.ndarray
    fine: np.ndarray
    fine_step: np.ndarray
    fine_error: np.ndarray

    def near(self, i: np.ndarray) -> np.ndarray:
        return self.coarse[i] * self.step[i, None] + self.fine[i] * self.fine_step[i, None]


def quantise(x: np.ndarray) -> Tile:
    def rounded(y):
        step = np.maximum(np.abs(y).max(axis=1) / 127, 1e-300)
        q = np.rint(y / step[:, None]).astype(np.int8)
        left = y - q * step[:, None]
        return q, step, left, np.sqrt((left**2).sum(axis=1)) + _EPS

    q, step, left, error = rounded(x)
    fine, fine_step, _, fine_error = rounded(left)
    return Tile(q, step, error, fine, fine_step, fine_error)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows (as float32, so that they run in BLAS): up to 1024 terms below 2^14 fit into its 24
    bits."""
    if a.shape[1] <= 1024:
        return a @ b.T
    return sum((a[:, k : k + 1024] @ b[:, k : k + 1024].T).astype(np.float64) for k in range(0, a.shape[1], 1024))


def tile_links(x: Tile, y: Tile, threshold: float, same: bool, rows: int = 512):
    """Yield (i, j, sure) of the pairs of rows of x and y whose cosine reaches the threshold for sure, or may reach it (sure
    is false); with same only i < j."""
    qx, qy = x.coarse.astype(np.float32), y.coarse.astype(np.float32)
    sx, ex, sy, ey = x.step, x.error, y.step, y.error
    for at in range(0, len(qx), rows):
        lo = at if same else 0
        p = _product(qx[at : at + rows], qy[lo:])
        e, s = ex[at : at + rows], sx[at : at + rows]
        least = (threshold - e - (1 + e) * ey[lo:].max(initial=0) - _EPS) / (s * sy[lo:].max(initial=1e-300))
        near = np.flatnonzero(p >= np.nextafter(least.astype(p.dtype), -np.inf)[:, None])
        i, j = near // p.shape[1], near % p.shape[1]
        about, off = p[i, j].astype(np.float64) * s[i] * sy[lo + j], e[i] + (1 + e[i]) * ey[lo + j] + _EPS
        i, j = i + at, j + lo
        keep = about + off >= threshold
        if same:
            keep &= i < j
        i, j, sure = i[keep], j[keep], (about - off >= threshold)[keep]
        may = sure.copy()
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), 1 << 16):
            part = open_[k : k + (1 << 16)]
            a, b = i[part], j[part]
            about, off = np.einsum("ij,ij->i", x.near(a), y.near(b)), x.fine_error[a] + (1 + x.fine_error[a]) * y.fine_error[b] + _EPS
            sure[part], may[part] = about - off >= threshold, about + off >= threshold
        yield i[may], j[may], sure[may]


def embedding_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tile_rows: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: other vectors linked with it, and the smallest key that links
    reach.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other, nor rows with a null key (component_id null, kept false).  Equal vectors are one
    class with a count, so copies in any number cost one vector; a key should belong to one vector (two under one key
    count as linked).  Repeated rows are links of their vector like other copies.  Other columns are not read; an empty table
    gives an empty one.  All distinct vectors meet in pairs of tiles: a pair of tiles travels as two rows of about tile_rows
    rounded vectors (two bytes for each number), links inside it are only counted for each vector, and a spanning forest of
    them is emitted, besides the pairs that rounding leaves open.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def valid(batches):
        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False)
            lens = np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lens)
            out = []
            for e, n, k in zip(ends.tolist(), lens.tolist(), b.column("k").is_valid().to_pylist()):
                x = flat[e - n : e]
                big = np.abs(x).max(initial=0) if k and n else 0.0
                if not (0 < big < np.inf) or np.isnan(x).any():
                    out.append(None)
                    continue
                x = x / big if not 1e-100 < big < 1e100 else x
                out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.binary())], names=["k", "v"])

    rows = cut(base.mapInArrow(valid, f"k {kind}, v binary"), "vectors")
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("k").alias("node"), F.count("*").alias("n")), "classes")
    tiles_n = max(1, -(-classes.count() // tile_rows))
    tiled = classes.select(F.pmod(F.xxhash64("v"), F.lit(tiles_n)).cast("int").alias("tile"), "node", "n", "v")

    def pack(table: pa.Table) -> pa.Table:
        """A row for each length of vectors in a tile."""
        vs = table.column("v").to_pylist()
        by: dict[int, list[int]] = {}
        for at, v in enumerate(vs):
            by.setdefault(len(v) // 8, []).append(at)
        sides = []
        for size, at in sorted(by.items()):
            x = np.frombuffer(b"".join(vs[a] for a in at)).reshape(len(at), size)
            t = quantise(x / np.sqrt((x * x).sum(axis=1))[:, None])
            sides.append({"at": at, "size": size, "coarse": t.coarse.tobytes(), "fine": t.fine.tobytes(), "facts": np.concatenate([t.step, t.error, t.fine_step, t.fine_error]).tobytes()})
        return pa.table({"tile": table.column("tile")[:1], "nodes": pa.array([table.column("node").to_pylist()], pa.list_(table.schema.field("node").type)), "ns": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), "vs": pa.array([sides], sides_type)})

    sides_type = pa.list_(pa.struct([("at", pa.list_(pa.int32())), ("size", pa.int32()), ("coarse", pa.binary()), ("fine", pa.binary()), ("facts", pa.binary())]))
    tiles = cut(tiled.groupBy("tile").applyInArrow(pack, f"tile int, nodes array<{kind}>, ns array<bigint>, vs array<struct<at:array<int>,size:int,coarse:binary,fine:binary,facts:binary>>"), "tiles")
    left = tiles.select(F.explode(F.sequence("tile", F.lit(tiles_n - 1))).alias("j"), F.col("tile").alias("i"), F.col("nodes").alias("nodes_i"), F.col("ns").alias("ns_i"), F.col("vs").alias("vs_i"))
    right = tiles.select(F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.col("nodes").alias("nodes_j"), F.col("ns").alias("ns_j"), F.col("vs").alias("vs_j"))

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                same = one["i"].as_py() == one["j"].as_py()
                sides = []
                for s in "ij":
                    unit = {}
                    for x in one[f"vs_{s}"].as_py():
                        at, facts = np.array(x["at"]), np.frombuffer(x["facts"]).reshape(4, -1)
                        coarse, fine = (np.frombuffer(x[c], np.int8).reshape(len(at), x["size"]) for c in ("coarse", "fine"))
                        unit[x["size"]] = at, Tile(coarse, facts[0], facts[1], fine, facts[2], facts[3])
                    sides.append((one[f"nodes_{s}"].values.to_numpy(zero_copy_only=False), one[f"ns_{s}"].values.to_numpy(), unit))
                (nodes_x, n_x, xs), (nodes_y, n_y, ys) = sides
                links_x, links_y = np.zeros(len(nodes_x), np.int64), np.zeros(len(nodes_y), np.int64)
                a, b, ask = [], [], []
                for size, (at_x, x) in xs.items():
                    if size not in ys:
                        continue
                    at_y, y = ys[size]
                    for i, j, sure in tile_links(x, y, threshold, same):
                        i, j = at_x[i], at_y[j]
                        if not sure.all():
                            ask.append((nodes_x[i[~sure]], nodes_y[j[~sure]]))
                            i, j = i[sure], j[sure]
                        links_x += np.bincount(i, n_y[j], len(nodes_x)).astype(np.int64)
                        links_y += np.bincount(j, n_x[i], len(nodes_y)).astype(np.int64)
                        f = local_forest(i, j) if same else local_forest(i, j + len(nodes_x))
                        a.append(f[0])
                        b.append(f[1])
                for p, q in ask:
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(np.full(len(p), -1))], names=["node", "other", "w"])
                if not a:
                    continue
                f = local_forest(np.concatenate(a), np.concatenate(b))
                every = nodes_x if same else np.concatenate([nodes_x, nodes_y])
                kx, ky = np.flatnonzero(links_x), np.flatnonzero(links_y)
                node = np.concatenate([nodes_x[kx], nodes_y[ky], every[f[0]]])
                other = pa.array(np.concatenate([nodes_x[kx], nodes_y[ky], every[f[1]]]), mask=np.arange(len(node)) < len(kx) + len(ky))
                yield pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(np.concatenate([links_x[kx], links_y[ky], np.zeros(len(f[0]), np.int64)]))], names=["node", "other", "w"])

    met = cut(left.join(right.hint("shuffle_hash"), ["i", "j"]).mapInArrow(meet, f"node {kind}, other {kind}, w bigint"), "met")
    x, y = (classes.select(F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("v").alias(f"v_{s}")) for s in "ij")
    asked = met.where("w < 0").select(F.col("node").alias("node_i"), F.col("other").alias("node_j")).join(x, "node_i").join(y, "node_j").where("octet_length(v_i) = octet_length(v_j)")

    def settle(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for r, (v, w) in enumerate(zip(b.column("v_i").to_pylist(), b.column("v_j").to_pylist())):
                v, w = np.frombuffer(v), np.frombuffer(w)
                ok[r] = (v / np.sqrt((v * v).sum())) @ (w / np.sqrt((w * w).sum())) >= threshold
            yield b.select(["node_i", "n_i", "node_j", "n_j"]).filter(pa.array(ok))

    more = cut(asked.mapInArrow(settle, f"node_i {kind}, n_i bigint, node_j {kind}, n_j bigint"), "settled")
    links = met.where("other is not null and w = 0").select("node", "other").unionByName(more.select(F.col("node_i").alias("node"), F.col("node_j").alias("other")))
    roots = components(links, "node", "other")
    count = met.where("other is null").select("node", "w").unionByName(more.select(F.col("node_i").alias("node"), F.col("n_j").alias("w"))).unionByName(more.select(F.col("node_j").alias("node"), F.col("n_i").alias("w")))
    count = count.groupBy("node").agg(F.sum("w").alias("w"))
    facts = classes.join(count, "node", "left").join(roots, "node", "left").select("v", F.col("node"), (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    return rows.join(facts, "v", "left").select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "k").alias("component_id"), F.coalesce(F.col("k") == F.coalesce("component_id", "k"), F.lit(False)).alias("kept")
    )
