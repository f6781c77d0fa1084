"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a value within r bits of both.  So every fingerprint emits all
values within r bits of itself, equal values meet, and whoever meets is linked.  The variants of a fingerprint travel
grouped by their leading bits: one row for each possible prefix stands for all variants with that prefix, and the task
that gets it unfolds them, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, drop_cut, give_back, sub_batches
from tidemark.llm.components import components, local_forest

BITS, SHINGLE, SEED = 64, 4, 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None])[0])


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words of a text, A-Z in lower case, in order; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(shingle, len(words))
    cuts = map(slice, starts[:n].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, cuts), repeat(seed)), np.uint64, n)


def majority(h: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words: the words whose bits are those set in over half of the rows; zeros without rows."""
    n, width = h.shape
    ones = np.zeros(width * BITS, np.int64)
    for at in range(0, n, 255):  # so many bits fit into a byte
        part = np.ascontiguousarray(h[at : at + 255]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fp") -> DataFrame:
    """(key, out): the SimHash of each row's whole text as a signed 64-bit integer.  A null or empty text gives 0."""
    kind = df.schema[key].dataType

    def run(batches):
        for b in sub_batches(batches, "t", 1 << 20):
            fp = np.fromiter((fingerprint(t) for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fp.view(np.int64))], names=[key, out])
        give_back()

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField(out, T.LongType())]))


def _ball(bits: int, radius: int) -> np.ndarray:
    """All words of `bits` bits with at most `radius` ones."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def nearest_forest(a: np.ndarray, b: np.ndarray, times: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links a-b between fingerprints that make a spanning forest of least distances: whatever a chain of links
    of some distance or less joins, these join by such links too.  Then, of what is left, another one, and so on, so that
    a link that turns out to be none has a way around it."""
    order = np.lexsort((b, a, np.bitwise_count(a ^ b)))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    take, left = [], list(enumerate(zip(ix[: len(a)].tolist(), ix[len(a) :].tolist())))
    for _ in range(times):
        up, over = list(range(len(nodes))), []
        for n, (x, y) in left:
            p, q = x, y
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            if p != q:
                up[max(p, q)] = min(p, q)
                take.append(n)
            else:
                over.append((n, (x, y)))
        left = over
    return a[take], b[take]


def _meet(fp: np.ndarray, top: np.ndarray, left: np.ndarray, bits: int, radius: int, most: int, thin: Callable = local_forest) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints of which a variant starts with `top` (all but the last `bits` bits), with `left` flips to go.

    If they have more than `most` variants, the next four bits are fixed to each value in turn.
    """
    balls = [_ball(bits, r) for r in range(radius + 1)]
    of = [np.flatnonzero(left == r) for r in range(radius + 1)]
    size = sum(len(i) * len(m) for i, m in zip(of, balls))
    if size > most and bits >= 4:
        out = []
        low = (fp >> np.uint64(bits - 4)) & np.uint64(15)
        for v in range(16):
            rest = left - np.bitwise_count(low ^ np.uint64(v)).astype(left.dtype)
            ok = rest >= 0
            if ok.sum() > 1:
                out += _meet(fp[ok], (top[ok] << np.uint64(4)) | np.uint64(v), rest[ok], bits - 4, radius, most, thin)
        return out
    last = np.uint64((1 << bits) - 1)
    base = (top << np.uint64(bits)) | (fp & last) if bits < BITS else fp
    v = np.concatenate([(base[i][:, None] ^ m[None, :]).ravel() for i, m in zip(of, balls)])
    s = np.sort(v)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return []
    seen = np.zeros(1 << 18, bool)
    spread = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
    seen[spread(twice)] = True
    hit = np.flatnonzero(seen[spread(v)])
    owner = np.concatenate([np.repeat(i, len(m)) for i, m in zip(of, balls)])[hit]
    v, x = v[hit], fp[owner]
    order = np.lexsort((x, v))
    v, x = v[order], x[order]
    first = np.concatenate([[True], v[1:] != v[:-1]])
    centre = x[np.flatnonzero(first)[np.cumsum(first) - 1]]
    link = centre != x
    a, b = centre[link], x[link]
    near = np.bitwise_count(a ^ b) <= 2 * radius
    return [thin(a[near], b[near])]


def _next(low: int, width: int) -> F.Column:
    """The `width` bits of a fingerprint above its last `low` bits."""
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _prefixes(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """rows with prefixes that are `width` bits longer, one for each that their variants can have.

    rows: fp, its bits that come next (next), the prefix so far, and the flips that are left.
    """
    masks = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(int(m).bit_count()).alias("n")) for m in _ball(width, radius)])
    out = rows.select("fp", "next", "prefix", "left", F.explode(masks).alias("flip")).where("flip.n <= left")
    return out.select("fp", F.shiftleft("prefix", width).bitwiseOR(F.col("next").bitwiseXOR(F.col("flip.m"))).alias("prefix"), (F.col("left") - F.col("flip.n")).alias("left"))


def _hot(rows: DataFrame, width: int, radius: int, most_rows: int) -> DataFrame | None:
    """Prefixes that more than most_rows rows would have, from counts of the rows' own bits; None if there are none."""
    counts = rows.groupBy("next", "prefix", "left").agg(F.count("*").alias("fp"))
    hot = cut(_prefixes(counts, width, radius).groupBy("prefix").agg(F.sum("fp").alias("n")).where(F.col("n") > most_rows).select("prefix"), "hot")
    if not hot.isEmpty():
        return hot
    drop_cut(hot)
    return None


def fingerprint_links(fps: DataFrame, column: str = "fp", distance: int = 4, bits: int = BITS, prefix_bits: int = 16, most_rows: int = 1 << 18, most_variants: int = 1 << 19, forest: bool = True, times: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join all those that chains of links join.

    Every two fingerprints at `distance` (even) or fewer differing bits meet in a variant; all that meet in one are
    linked to its smallest, after a check of the distance.  A task emits a spanning forest of what it found; with forest
    false `times` of least distances, of links that it found, so that they can be verified.  Only the last `bits` bits may differ; those above tell tables of fingerprints apart.

    Variants with one prefix are unfolded by one task, in bounded numbers.  A prefix that more than most_rows
    fingerprints can have is split by its next eight bits, and again while need be, so that neither many fingerprints nor
    many near ones meet in one task.
    """
    radius = distance // 2
    if distance != 2 * radius:
        raise ValueError("the distance must be even")
    thin = local_forest if forest else partial(nearest_forest, times=times)
    table = F.shiftrightunsigned("fp", bits) if bits < BITS else F.lit(0).cast("long")
    base = fps.select(F.col(column).alias("fp")).where(F.col(column).isNotNull()).distinct()
    low, width, out = bits - prefix_bits, prefix_bits, None
    rows = base.select("fp", _next(low, width).alias("next"), table.alias("prefix"), F.lit(radius).alias("left"))
    while True:
        spread = _prefixes(rows, width, radius)
        hot = _hot(rows, width, radius, most_rows) if low > 8 else None
        part = _unfolded(spread if hot is None else spread.join(hot, "prefix", "left_anti"), low, radius, most_variants, thin)
        out = part if out is None else out.unionByName(part)
        if hot is None:
            return out if forest else out.distinct()
        low, width = low - 8, 8
        rows = cut(spread.join(hot, "prefix").select("fp", _next(low, width).alias("next"), "prefix", "left"), "split")


def _unfolded(rows: DataFrame, low: int, radius: int, most_variants: int, thin: Callable) -> DataFrame:
    """Links among rows (fp, prefix) that share a prefix, all but the last `low` bits of a variant."""
    rows = rows.select("fp", "prefix").repartition("prefix").sortWithinPartitions("prefix")

    def run(batches):
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held, cost = [], 0

        def work(parts):
            fp, prefix = (np.concatenate(x) for x in zip(*parts))
            left = radius - np.bitwise_count((fp >> np.uint64(low)) ^ prefix).astype(np.int64)
            links.extend(_meet(fp, prefix, left, low, radius, most_variants, thin))

        def settle():
            a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.uint64),) * 2
            links.clear()
            return thin(a, b)

        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            prefix = b.column("prefix").to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(prefix)) + 1
            step = max(1, (most_variants * 3) // 50 // 4)  # about 12 variants a row on average
            at = 0
            for e in edges:
                if cost + e - at > step:
                    held.append((fp[at:e], prefix[at:e]))
                    work(held)
                    held, cost, at = [], 0, e
            held.append((fp[at:], prefix[at:]))
            cost += len(fp) - at
            if sum(len(x[0]) for x in links) > 1 << 20:
                links.append(settle())
        if held:
            work(held)
        a, c = settle()
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])
        give_back()

    return rows.mapInArrow(run, "a bigint, b bigint")


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, prefix_bits: int = 16) -> DataFrame:
    """(key, fingerprint, component_id) for each row of df: 16 hex digits, and the smallest key that links reach.

    Fingerprints link at `distance` or fewer differing bits; equal ones always link, that of empty and null texts (zero)
    like any other.  A null key is never a component's smallest unless it is alone with nulls; repeated rows stay; other
    columns are not read.
    """
    prints = cut(fingerprints(df, key, text), "prints")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(fingerprint_links(prints, "fp", distance, prefix_bits=prefix_bits))
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = cut(of, "classes")
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(of.join(smallest, "root").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select(key, hexed.alias("fingerprint"), "component_id")
