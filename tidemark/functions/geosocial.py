"""Column expressions: influence, scores and their bounds, road distances, planar codes, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA, BASE = 0.6, 6.0


def influence(soc: Column, a: float = BASE, alpha: float = ALPHA) -> Column:
    """One without social pull (or weight for it), else 1 + a ** soc."""
    if a == 0 or alpha == 0:
        return F.lit(1.0)
    return F.when(soc > 0, 1 + F.pow(F.lit(float(a)), soc)).otherwise(1.0)


def gsk_score(rel: Column, inf: Column, dist: Column, alpha: float = ALPHA) -> Column:
    """Keyword, social and distance score; 0 without relevance."""
    return F.when(rel > 0, (alpha * inf + (1 - alpha) * rel) / (1 + dist)).otherwise(0.0)


def upper_score(rel: Column, least: Column, a: float = BASE, alpha: float = ALPHA) -> Column:
    """No score of this relevance at this or a larger distance is higher."""
    return gsk_score(rel, F.lit(1.0 + a if a and alpha else 1.0), least, alpha)


def lower_score(rel: Column, most: Column, alpha: float = ALPHA) -> Column:
    """No score of this relevance at this or a smaller distance is lower."""
    return gsk_score(rel, F.lit(1.0), most, alpha)


def vertex_offset(v: Column, ni: Column, nj: Column, dist: Column, dis: Column, d_ni: Column, d_nj: Column) -> Column:
    """Distance of a vertex to a place on an edge, given its distances to the edge's ends."""
    return F.when(v == ni, dis).when(v == nj, dist - dis).otherwise(F.least(d_ni + dis, d_nj + dist - dis))


def place_distance(u: dict[str, Column], p: dict[str, Column], d: dict[tuple[str, str], Column], exact: bool = False) -> Column:
    """Distance of two places on edges.

    u, p: ni, nj, dist, dis of each; d: distances between the ends of p (first) and u.  On one edge the offsets are
    compared; with one lower end only, the offsets are added (exact=True takes the shortest way there too).
    """
    by = {e: vertex_offset(p[e], u["ni"], u["nj"], u["dist"], u["dis"], d[e, "ni"], d[e, "nj"]) for e in ("ni", "nj")}
    far = F.least(by["ni"] + p["dis"], by["nj"] + p["dist"] - p["dis"])
    same = (u["ni"] == p["ni"]) & (u["nj"] == p["nj"])
    out = F.when(same, F.abs(u["dis"] - p["dis"]))
    if not exact:
        out = out.when(u["ni"] == p["ni"], u["dis"] + p["dis"])
    return out.otherwise(far)


def edge_key(ni: Column, nj: Column, n: int) -> Column:
    return F.least(ni, nj) * n + F.greatest(ni, nj)


def edge_ends(key: Column, n: int) -> tuple[Column, Column]:
    return F.floor(key / n), key % n


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of x and y interleaved, x lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        one = lambda c, to: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), to)  # noqa: B023, E731
        out = out + one(x.cast("long"), 2 * i) + one(y.cast("long"), 2 * i + 1)
    return out


def unmorton(code: Column, bits: int = 16) -> tuple[Column, Column]:
    def half(first: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(bits):
            out = out + F.shiftleft(F.shiftright(code, 2 * i + first).bitwiseAND(F.lit(1).cast("long")), i)
        return out

    return half(0), half(1)


def extended_jaccard(dot: Column, a: Column, b: Column) -> Column:
    """Product of two count vectors over the sum of their squares less it."""
    return F.when(a + b - dot > 0, dot / (a + b - dot)).otherwise(0.0)


def point_rect(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Least and largest distance of a point to a rectangle."""
    dx, dy = F.greatest(x0 - x, F.lit(0.0), x - x1), F.greatest(y0 - y, F.lit(0.0), y - y1)
    fx, fy = F.greatest(F.abs(x - x0), F.abs(x - x1)), F.greatest(F.abs(y - y0), F.abs(y - y1))
    return F.hypot(dx, dy), F.hypot(fx, fy)


def draw(*parts: Column, seed: int = 1) -> Column:
    """Reproducible number from 0 to 2 ** 32 - 1 for a key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
