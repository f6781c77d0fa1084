"""DuckDB SQL of the named queries, put together from the definitions of the tables that they stand on.

The definitions are written from the semantics alone and share nothing with the DataFrame code: distances, for example,
come from a recursive relaxation here and from min-plus squaring there.
"""

from __future__ import annotations

ROUNDS = 16


def _hash(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint)"


def _place(table: str, key: str) -> str:
    """Distance of every vertex to every place on an edge."""
    return f"""SELECT dd.s AS v, z.{key}, CASE WHEN dd.s = z.ni THEN z.dis WHEN dd.s = z.nj THEN z.dist - z.dis ELSE least(dd.d + z.dis, d2.d + z.dist - z.dis) END AS dist
        FROM {table} z JOIN dd ON dd.t = z.ni JOIN dd d2 ON d2.t = z.nj AND d2.s = dd.s"""


#: name -> (tables that it needs, definition)
PARTS: dict[str, tuple[str, str]] = {
    "nu": ("", "SELECT count(*)::bigint AS n FROM customer"),
    "np": ("", "SELECT count(*)::bigint AS n FROM supplier"),
    "kk": ("np", "SELECT CASE WHEN n >= 20 THEN 20 ELSE 3 END AS k FROM np"),
    "vertex": ("", "SELECT n_nationkey::bigint AS v, (n_nationkey % 5)::double AS x, (n_nationkey // 5)::double AS y FROM nation"),
    "edge": (
        "vertex",
        """SELECT row_number() OVER (ORDER BY ni, nj) - 1 AS eid, ni, nj, (3 + (7 * ni + 11 * nj) % 10)::double AS dist
        FROM (SELECT v AS ni, v + 1 AS nj FROM vertex WHERE v % 5 < 4 UNION ALL SELECT v, v + 5 FROM vertex WHERE v < 20)""",
    ),
    "users": ("edge", "SELECT c_custkey::bigint AS u, ni, nj, dist, dist * ((13 * c_custkey) % 10) / 10 AS dis FROM customer JOIN edge ON eid = (7 * c_custkey) % 40"),
    "pois": ("edge", "SELECT s_suppkey::bigint AS p, ni, nj, dist, dist * ((3 * s_suppkey) % 10) / 10 AS dis FROM supplier JOIN edge ON eid = (11 * s_suppkey) % 40"),
    "user_term": (
        "",
        """SELECT u, term FROM (SELECT o_custkey::bigint AS u, p_brand AS term, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_brand) AS r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand) WHERE r <= 3""",
    ),
    "poi_term": (
        "",
        """SELECT p, term FROM (SELECT l_suppkey::bigint AS p, p_brand AS term, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) WHERE r <= 4""",
    ),
    "checkin": ("", "SELECT l_suppkey::bigint AS p, o_custkey::bigint AS u, count(*)::bigint AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"),
    "friend": (
        "nu",
        """SELECT DISTINCT u, v FROM (SELECT c_custkey::bigint AS u, unnest([(31 * c_custkey + 7) % n, (17 * c_custkey + 3) % n, (c_custkey + 1) % n])::bigint AS v FROM customer, nu) WHERE u <> v""",
    ),
    "und": ("friend", "SELECT u, v FROM friend UNION SELECT v, u FROM friend"),
    "ask": ("", "SELECT s_suppkey::bigint AS p FROM supplier WHERE s_suppkey < 5"),
    "idf": ("poi_term np", "SELECT term, df, log2(n::double / df) AS idf FROM (SELECT term, count(DISTINCT p)::bigint AS df FROM poi_term GROUP BY term), np"),
    "trank": ("idf", "SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS rank FROM idf"),
    "rel": ("user_term poi_term idf", "SELECT u, p, sum(idf) AS rel FROM user_term JOIN poi_term USING (term) JOIN idf USING (term) GROUP BY u, p HAVING sum(idf) > 0"),
    "fc": ("friend checkin", "SELECT f.u, c.p, count(DISTINCT f.v)::bigint AS n FROM friend f JOIN checkin c ON c.u = f.v GROUP BY f.u, c.p"),
    "fm": ("fc", "SELECT u, max(n) AS m FROM fc GROUP BY u"),
    "soc": ("fc fm", "SELECT u, p, n / m AS soc FROM fc JOIN fm USING (u)"),
    "roads": ("edge", "SELECT ni AS a, nj AS b, dist AS w FROM edge UNION ALL SELECT nj, ni, dist FROM edge"),
    "d0": ("vertex roads", "SELECT v AS s, v AS t, 0.0::double AS d FROM vertex UNION ALL SELECT a, b, w FROM roads"),
    "leaf": ("vertex", "SELECT v, (lx & 1) + 2 * (ly & 1) + 4 * (lx >> 1) + 8 * (ly >> 1) AS leaf FROM (SELECT v, floor(x / 2)::bigint AS lx, floor(y / 2)::bigint AS ly FROM vertex)"),
    "border": ("leaf roads", "SELECT DISTINCT l1.leaf, l1.v FROM roads JOIN leaf l1 ON l1.v = a JOIN leaf l2 ON l2.v = b WHERE l1.leaf <> l2.leaf"),
    "vu": ("users dd", _place("users", "u")),
    "vp": ("pois dd", _place("pois", "p")),
    "far": (
        "users pois vu",
        """SELECT a.u, b.p, CASE WHEN a.ni = b.ni AND a.nj = b.nj THEN abs(a.dis - b.dis) WHEN a.ni = b.ni THEN a.dis + b.dis ELSE least(x.dist + b.dis, y.dist + b.dist - b.dis) END AS dist
        FROM users a CROSS JOIN pois b JOIN vu x ON x.v = b.ni AND x.u = a.u JOIN vu y ON y.v = b.nj AND y.u = a.u""",
    ),
    "farrel": (
        "users pois vu rel",
        """SELECT a.u, b.p, CASE WHEN a.ni = b.ni AND a.nj = b.nj THEN abs(a.dis - b.dis) WHEN a.ni = b.ni THEN a.dis + b.dis ELSE least(x.dist + b.dis, y.dist + b.dist - b.dis) END AS dist
        FROM rel JOIN users a USING (u) JOIN pois b USING (p) JOIN vu x ON x.v = b.ni AND x.u = a.u JOIN vu y ON y.v = b.nj AND y.u = a.u""",
    ),
    "scored": ("rel soc farrel", """SELECT u, p, rel, inf, dist, round((0.6 * inf + 0.4 * rel) / (1 + dist), 9) AS score FROM (
        SELECT rel.u, rel.p, rel.rel, CASE WHEN coalesce(soc, 0) > 0 THEN 1 + pow(6.0, soc) ELSE 1.0 END AS inf, f.dist FROM rel JOIN farrel f USING (u, p) LEFT JOIN soc USING (u, p))"""),
    "best": ("scored kk", "SELECT * FROM (SELECT u, p, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, p) AS rank FROM scored) WHERE rank <= (SELECT k FROM kk)"),
    "kth": ("best kk", "SELECT u, score AS rk FROM best WHERE rank = (SELECT k FROM kk)"),
    "rev": ("scored kth", "SELECT s.*, coalesce(rk, 0.0) AS rk FROM scored s LEFT JOIN kth USING (u) WHERE score > coalesce(rk, 0.0)"),
    "cells": ("poi_term vp", "SELECT term, v, p, dist FROM (SELECT term, v, p, dist, row_number() OVER (PARTITION BY term, v ORDER BY round(dist, 9), p) AS r FROM poi_term JOIN vp USING (p)) WHERE r = 1"),
    "prob": ("und", "SELECT u, v, 1.0::double / count(*) OVER (PARTITION BY v) AS prob FROM und"),
    "rounds": ("", f"SELECT range::bigint AS round FROM range({ROUNDS})"),
    "live": ("prob rounds", f"SELECT round, u, v FROM prob, rounds WHERE ({_hash("'1|' || round || '|' || u || '|' || v")} % 1001) / 1000 <= prob"),
    "seeds": ("checkin", "SELECT DISTINCT p, u FROM checkin WHERE p < 5"),
    "roots": ("rounds nu", f"SELECT round, {_hash("'1|root|' || round")} % n AS node FROM rounds, nu"),
    "onehop": (
        "seeds prob",
        """SELECT p, n + coalesce(gain, 0) AS spread FROM (SELECT p, count(*) AS n FROM seeds GROUP BY p) LEFT JOIN (SELECT p, sum(chance) AS gain FROM (
        SELECT s.p, e.v, CASE WHEN max(prob) >= 1 THEN 1 ELSE 1 - exp(sum(ln(1 - least(prob, 1 - 1e-15)))) END AS chance FROM seeds s JOIN prob e ON e.u = s.u GROUP BY s.p, e.v) GROUP BY p) USING (p)""",
    ),
    "onehop2": (
        "seeds prob",
        """SELECT p, n + coalesce(gain, 0) AS spread FROM (SELECT p, count(*) AS n FROM seeds GROUP BY p) LEFT JOIN (SELECT p, sum(chance) AS gain FROM (
        SELECT s.p, e.v, CASE WHEN max(prob) >= 1 THEN 1 ELSE 1 - exp(sum(ln(1 - least(prob, 1 - 1e-15)))) END AS chance FROM seeds s JOIN prob e ON e.u = s.u GROUP BY s.p, e.v)
        WHERE (p, v) NOT IN (SELECT (p, u) FROM seeds) GROUP BY p) USING (p)""",
    ),
    "links": ("rev", "SELECT DISTINCT p, u FROM rev WHERE p < 5"),
    "zt": ("trank np", "SELECT term, df, floor(0.15 * n / rank)::bigint AS target FROM trank, np"),
    "raw": ("edge", "SELECT ni, nj, dist FROM edge UNION ALL SELECT nj, ni, dist + 1 FROM edge UNION ALL SELECT ni, ni, dist FROM edge"),
    "span": ("dd leaf", "SELECT a.leaf AS l1, b.leaf AS l2, min(d) AS lo, max(d) AS hi FROM dd JOIN leaf a ON a.v = s JOIN leaf b ON b.v = t GROUP BY ALL"),
    "lb": (
        "dd border leaf",
        """SELECT n1, n2, d AS dmin, d + f1.far + f2.far AS dmax FROM (SELECT a.leaf AS n1, b.leaf AS n2, s, t, d, row_number() OVER (PARTITION BY a.leaf, b.leaf ORDER BY d, s, t) AS r
        FROM dd JOIN border a ON a.v = s JOIN border b ON b.v = t WHERE a.leaf <> b.leaf) JOIN (SELECT s, max(d) AS far FROM dd JOIN leaf x ON x.v = s JOIN leaf y ON y.v = t WHERE x.leaf = y.leaf GROUP BY s) f1 USING (s)
        JOIN (SELECT s AS t, max(d) AS far FROM dd JOIN leaf x ON x.v = s JOIN leaf y ON y.v = t WHERE x.leaf = y.leaf GROUP BY s) f2 USING (t) WHERE r = 1""",
    ),
    "thin": ("edge", "SELECT ni AS a, nj AS b, dist AS w FROM edge WHERE (ni + nj) % 3 <> 0 UNION ALL SELECT nj, ni, dist FROM edge WHERE (ni + nj) % 3 <> 0"),
}

# all pairs: paths of at most 24 edges, each step keeping the shortest
_relax = ["dd1 AS MATERIALIZED (SELECT s, t, min(d) AS d FROM d0 GROUP BY s, t)"]
for _i in range(2, 25):
    _relax.append(f"dd{_i} AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM dd{_i - 1} UNION ALL SELECT s, b, d + w FROM dd{_i - 1} JOIN roads ON a = t) GROUP BY s, t)")
PARTS["dd"] = ("d0 roads", "SELECT s, t, d FROM dd24")

# three greedy steps by one-hop spread, each from its definition: the union of the users of the chosen and one more place
for _i in (1, 2, 3):
    _had = "1 = 0" if _i == 1 else "p IN (" + " UNION ALL ".join(f"SELECT p FROM gp{j}" for j in range(1, _i)) + ")"
    _need = " ".join(["links prob", *(f"gp{j}" for j in range(1, _i))])
    PARTS[f"gu{_i}"] = (_need, f"SELECT p, u FROM links WHERE NOT ({_had}) UNION SELECT q.p, l.u FROM (SELECT DISTINCT p FROM links WHERE NOT ({_had})) q, (SELECT u FROM links WHERE {_had}) l")
    PARTS[f"gp{_i}"] = (
        f"gu{_i}",
        f"""SELECT p, spread FROM (SELECT p, n + coalesce(gain, 0) AS spread FROM (SELECT p, count(*) AS n FROM gu{_i} GROUP BY p) LEFT JOIN (SELECT p, sum(chance) AS gain FROM (
        SELECT s.p, e.v, CASE WHEN max(prob) >= 1 THEN 1 ELSE 1 - exp(sum(ln(1 - least(prob, 1 - 1e-15)))) END AS chance FROM gu{_i} s JOIN prob e ON e.u = s.u GROUP BY s.p, e.v) GROUP BY p) USING (p))
        ORDER BY round(spread, 9) DESC, p LIMIT 1""",
    )
# linear thresholds: forty steps, of which the last ones turn nobody on
PARTS["lt0"] = ("seeds rounds", "SELECT round, u AS node FROM seeds, rounds WHERE p = 0")
for _i in range(1, 41):
    PARTS[f"lt{_i}"] = (
        f"lt{_i - 1} prob",
        f"""SELECT round, node FROM lt{_i - 1} UNION SELECT round, v FROM (SELECT round, v, sum(prob) AS pull FROM lt{_i - 1} JOIN prob ON prob.u = node GROUP BY round, v)
        WHERE round(pull, 9) >= ({_hash("'1|lt|' || round || '|' || v")} % 1001) / 1000""",
    )


def _graph_steps(name: str, seed: int, graphs: int = 200) -> None:
    """Three greedy steps by what places reach in sampled live-edge graphs."""
    RECURSIVE[f"{name}r"] = (
        "links prob",
        f"""SELECT p, range::bigint AS round, u AS node FROM links, range({graphs}) UNION SELECT r.p, r.round, e.v FROM {name}r r JOIN prob e ON e.u = r.node
        WHERE ({_hash(f"'{seed}|' || r.round || '|' || e.u || '|' || e.v")} % 1001) / 1000 <= e.prob""",
    )
    PARTS[f"{name}m"] = (f"{name}r", f"SELECT p, round, node FROM {name}r")
    for i in (1, 2, 3):
        had = " UNION ALL ".join(f"SELECT p FROM {name}{j}" for j in range(1, i))
        gone = f"WHERE (round, node) NOT IN (SELECT (round, node) FROM {name}m WHERE p IN ({had})) AND p NOT IN ({had})" if had else ""
        need = " ".join([f"{name}m", *(f"{name}{j}" for j in range(1, i))])
        left = f"(SELECT p, count(*) AS n FROM {name}m {gone} GROUP BY p)"
        PARTS[f"{name}{i}"] = (need, f"SELECT p, n / {graphs} AS gain FROM {left} ORDER BY n DESC, p LIMIT 1")


#: recursive parts, named by what they reach
RECURSIVE: dict[str, tuple[str, str]] = {
    "comp": ("vertex thin", "SELECT v AS a0, v AS z FROM vertex UNION SELECT a0, b FROM comp JOIN thin ON a = z"),
    "reached": ("seeds und", "SELECT u AS node FROM seeds WHERE p = 0 UNION SELECT v FROM reached JOIN und ON und.u = node"),
    "rr": ("roots live", "SELECT round, node, 0 AS depth FROM roots UNION SELECT rr.round, live.u, least(depth + 1, 40) FROM rr JOIN live ON live.round = rr.round AND live.v = node WHERE depth < 40"),
    "ic": ("seeds rounds live", "SELECT round, u AS node FROM seeds, rounds WHERE p = 0 UNION SELECT ic.round, live.v FROM ic JOIN live ON live.round = ic.round AND live.u = node"),
}

for _name, _seed in (("celf", 7), ("pmc", 5)):
    _graph_steps(_name, _seed)
RECURSIVE["chain"] = (
    "thin",
    """SELECT a AS a0, b AS b0, a AS before, b AS last, w AS length FROM thin UNION ALL SELECT c.a0, c.b0, c.last, t.b, c.length + t.w FROM chain c JOIN thin t ON t.a = c.last AND t.b <> c.before
    WHERE c.last <> c.a0 AND c.last IN (SELECT a FROM thin GROUP BY a HAVING count(*) = 2)""",
)


def _steps(name: str) -> str:
    return " UNION ALL ".join(f"SELECT {i}::bigint AS step, p, round(gain, 6) AS gain FROM {name}{i}" for i in (1, 2, 3))


def _with(names: str, body: str) -> str:
    """The body behind the definitions of the named tables and all that these need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for n in (RECURSIVE.get(name) or PARTS[name])[0].split():
            need(n)
        order.append(name)

    for n in names.split():
        need(n)
    parts = []
    for n in order:
        if n == "dd":
            parts += _relax
        if n in RECURSIVE:
            parts.append(f"{n} AS ({RECURSIVE[n][1]})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({PARTS[n][1]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


_RESULT = "p, u, round(rel, 6) AS rel, round(inf, 6) AS inf, round(dist, 6) AS dist, round(score, 6) AS score, round(rk, 6) AS rk"

SQL: dict[str, str] = {
    "road_vertices": _with("vertex", "SELECT * FROM vertex"),
    "road_edges": _with("edge", "SELECT * FROM edge"),
    "users_placed": _with("users", "SELECT u, ni, nj, dist, round(dis, 6) AS dis FROM users"),
    "pois_placed": _with("pois", "SELECT p, ni, nj, dist, round(dis, 6) AS dis FROM pois"),
    "user_terms": _with("user_term", "SELECT * FROM user_term"),
    "poi_terms": _with("poi_term", "SELECT * FROM poi_term"),
    "checkins": _with("checkin", "SELECT * FROM checkin"),
    "friends": _with("friend", "SELECT * FROM friend"),
    "friends_undirected": _with("und", "SELECT * FROM und"),
    "edges_dedup_undirected": _with("raw", "SELECT least(ni, nj) AS ni, greatest(ni, nj) AS nj, min(dist) AS dist FROM raw WHERE ni <> nj GROUP BY ALL"),
    "edges_euclid_floor": _with("edge vertex", "SELECT ni, nj, greatest(dist, ceil(sqrt(pow(9 * (a.x - b.x), 2) + pow(9 * (a.y - b.y), 2)))) AS dist FROM edge JOIN vertex a ON a.v = ni JOIN vertex b ON b.v = nj"),
    "degree_histogram": _with("roads", "SELECT degree, count(*)::bigint AS n FROM (SELECT a, count(*)::bigint AS degree FROM roads GROUP BY a) GROUP BY degree"),
    "duplicate_coordinates": _with("vertex", "SELECT v FROM vertex a WHERE EXISTS (SELECT 1 FROM vertex b WHERE b.x % 3 = a.x % 3 AND b.y = a.y AND b.v < a.v)"),
    "drop_isolated": _with("vertex edge", "SELECT * FROM vertex WHERE v IN (SELECT unnest([ni, nj]) FROM edge WHERE ni % 7 <> 0 AND nj % 7 <> 0)"),
    "component_labels": _with("comp", "SELECT a0 AS v, min(z) AS root FROM comp GROUP BY a0"),
    "largest_component": _with("comp", "SELECT a0 AS v FROM comp GROUP BY a0 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM comp GROUP BY a0))"),
    "dense_reid": _with("checkin", "SELECT u, row_number() OVER (ORDER BY u) - 1 AS id FROM (SELECT DISTINCT u FROM checkin)"),
    "term_rank_by_df": _with("trank", "SELECT term, df, rank FROM trank"),
    "friends_capped": _with("friend", "SELECT * FROM friend WHERE u < 100 AND v < 100"),
    "coordinate_ranges": _with("vertex", "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM vertex"),
    "zipf_target_freq": _with("trank np", "SELECT term, rank, df, floor(0.15 * n / rank)::bigint AS target FROM trank, np"),
    "zipf_deficit": _with("trank np", "SELECT term, floor(0.15 * n / rank)::bigint - df AS deficit FROM trank, np"),
    **{f"subset_{x}": f"SELECT s_suppkey::bigint AS p FROM supplier WHERE {_hash("'1|subset|' || s_suppkey")} % 100 < {x}" for x in (60, 70, 80, 90)},
    "hash_sample": f"SELECT c_custkey::bigint AS u FROM customer ORDER BY {_hash("'1|sample|' || c_custkey")}, c_custkey LIMIT 50",
    "hash_pairs": f"SELECT range::bigint AS pair, {_hash("'1|a|' || range")} % (SELECT count(*) FROM nation) AS a, {_hash("'1|b|' || range")} % (SELECT count(*) FROM nation) AS b FROM range(40)",
    "distance_buckets": _with("dd", "SELECT t, floor(d * 4 / m)::bigint AS bucket FROM dd, (SELECT max(d) AS m FROM dd WHERE s = 12) WHERE s = 12 AND d < m"),
    "term_idf": _with("idf", "SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "posting_size": _with("user_term poi_term", "SELECT term, coalesce(n_pois, 0) AS n_pois, coalesce(n_users, 0) AS n_users FROM (SELECT term, count(*)::bigint AS n_pois FROM poi_term GROUP BY term) FULL JOIN (SELECT term, count(*)::bigint AS n_users FROM user_term GROUP BY term) USING (term)"),
    "relevance_pairs": _with("rel", "SELECT u, p, round(rel, 6) AS rel FROM rel"),
    "group_keywords": _with("poi_term ask", "SELECT DISTINCT term FROM poi_term JOIN ask USING (p)"),
    "group_keywords_le200": _with("poi_term ask trank", "SELECT DISTINCT term, rank FROM poi_term JOIN ask USING (p) JOIN trank USING (term) WHERE rank <= 200"),
    "extended_jaccard": _with(
        "checkin user_term",
        """SELECT n1, n2, round(dot / (s1 + s2 - dot), 6) AS sim FROM (WITH c AS (SELECT p, term, count(*) AS n FROM checkin JOIN user_term USING (u) GROUP BY ALL), q AS (SELECT p, sum(n * n)::double AS s FROM c GROUP BY p)
        SELECT a.p AS n1, b.p AS n2, sum(a.n * b.n)::double AS dot, any_value(x.s) AS s1, any_value(y.s) AS s2 FROM c a JOIN c b USING (term) JOIN q x ON x.p = a.p JOIN q y ON y.p = b.p WHERE a.p < b.p GROUP BY a.p, b.p)""",
    ),
    "friend_checkin_counts": _with("fc", "SELECT * FROM fc"),
    "max_friend_checkin": _with("fm", "SELECT * FROM fm"),
    "social_score": _with("soc", "SELECT u, p, round(soc, 6) AS soc FROM soc"),
    "apsp": _with("dd", "SELECT * FROM dd"),
    "sssp": _with("dd", "SELECT * FROM dd WHERE s IN (0, 12)"),
    "user_poi_distance": _with("far", "SELECT u, p, round(dist, 6) AS dist FROM far WHERE p < 5"),
    "knn_objects": _with("vp", "SELECT * FROM (SELECT v, p, round(dist, 6) AS dist, row_number() OVER (PARTITION BY v ORDER BY round(dist, 9), p) AS rank FROM vp) WHERE rank <= 5"),
    "network_knn_users": _with("far", "SELECT * FROM (SELECT p, u, round(dist, 6) AS dist, row_number() OVER (PARTITION BY p ORDER BY round(dist, 9), u) AS rank FROM far WHERE p < 5) WHERE rank <= 10"),
    "landmark_bounds": _with("dd", "SELECT a.t AS s, b.t AS t, max(abs(a.d - b.d)) AS lower, min(a.d + b.d) AS upper FROM dd a JOIN dd b USING (s) WHERE s IN (0, 4, 20, 24) GROUP BY a.t, b.t"),
    "partition_leaves": _with("leaf", "SELECT * FROM leaf"),
    "node_ancestors": _with("leaf", "SELECT v, level::bigint AS level, leaf // (4 ** level)::bigint AS node FROM leaf, (VALUES (0), (1), (2)) l(level)"),
    "partition_borders": _with("border", "SELECT * FROM border"),
    "leaf_distance_bounds": _with("lb", "SELECT n1, n2, dmin, dmax FROM lb"),
    "node_distance_bounds": _with("lb", "SELECT n1 // 4 AS n1, n2 // 4 AS n2, min(dmin) AS dmin, max(dmax) AS dmax FROM lb WHERE n1 // 4 <> n2 // 4 GROUP BY ALL"),
    "leaf_diameter": _with("dd leaf", "SELECT a.leaf, max(d) AS far FROM dd JOIN leaf a ON a.v = s JOIN leaf b ON b.v = t WHERE a.leaf = b.leaf GROUP BY a.leaf"),
    "first_hops": _with("dd roads", "SELECT x.s, x.t, min(b) AS hop FROM dd x JOIN roads ON a = x.s JOIN dd y ON y.s = b AND y.t = x.t WHERE x.s <> x.t AND abs(w + y.d - x.d) < 1e-9 GROUP BY x.s, x.t"),
    "euclid_knn": _with("vertex", "SELECT q, v, round(dist, 6) AS dist FROM (SELECT a.v AS q, b.v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, row_number() OVER (PARTITION BY a.v ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.v) AS r FROM vertex a, vertex b WHERE a.v <> b.v) WHERE r <= 4"),
    "window_rectangle": _with("vertex", "SELECT * FROM vertex WHERE x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2"),
    "morton_codes": _with("vertex", "SELECT v, (SELECT sum((((x::bigint >> i) & 1) << (2 * i)) + (((y::bigint >> i) & 1) << (2 * i + 1))) FROM (VALUES (0), (1), (2), (3)) b(i))::bigint AS code FROM vertex"),
    "edge_keys": _with("edge", "SELECT ni * 25 + nj AS key, ni, nj FROM edge"),
    "gsk_score": _with("scored", "SELECT u, p, round(rel, 6) AS rel, round(inf, 6) AS inf, round(dist, 6) AS dist, round(score, 6) AS score FROM scored"),
    "sk_score": _with("rel far", "SELECT u, p, round(round((0.6 + 0.4 * rel) / (1 + dist), 9), 6) AS score FROM rel JOIN far USING (u, p)"),
    "gsk_bounds": _with(
        "rel users pois leaf span edge",
        """SELECT u, p, round((0.6 + 0.4 * rel) / (1 + hi + 2 * m), 6) AS low, round((0.6 * 7 + 0.4 * rel) / (1 + greatest(lo - 2 * m, 0)), 6) AS top
        FROM rel JOIN users a USING (u) JOIN pois b USING (p) JOIN leaf x ON x.v = a.ni JOIN leaf y ON y.v = b.ni JOIN span ON l1 = x.leaf AND l2 = y.leaf, (SELECT max(dist) AS m FROM edge)""",
    ),
    "nearest_poi_by_term": _with("cells", "SELECT term, v, p, round(dist, 6) AS dist FROM cells"),
    "voronoi_adjacency": _with("cells roads", "SELECT DISTINCT x.term, least(x.p, y.p) AS p1, greatest(x.p, y.p) AS p2 FROM roads JOIN cells x ON x.v = a JOIN cells y ON y.v = b AND y.term = x.term WHERE x.p <> y.p"),
    "voronoi_leaves": _with("cells leaf", "SELECT DISTINCT term, leaf, p FROM cells JOIN leaf USING (v)"),
    "user_topk": _with("best", "SELECT u, p, round(score, 6) AS score, rank FROM best"),
    "user_kth_score": _with("kth", "SELECT u, round(rk, 6) AS rk FROM kth"),
    "reverse_topk_batch": _with("rev", f"SELECT {_RESULT} FROM rev WHERE p < 5"),
    "reverse_topk_single": _with("rev", f"SELECT {_RESULT} FROM rev WHERE p = 0"),
    "reverse_topk_nonstrict": _with("scored kth", f"SELECT {_RESULT} FROM (SELECT s.*, coalesce(k.rk, 0.0) AS rk FROM (SELECT * FROM scored WHERE p < 5) s LEFT JOIN kth k USING (u)) WHERE score >= rk"),
    "reverse_topk_bound": _with("rev", f"SELECT {_RESULT} FROM rev WHERE p < 5"),
    "reverse_topk_given_keywords": _with(
        "user_term poi_term idf soc far kth",
        f"""SELECT {_RESULT} FROM (SELECT q.*, round((0.6 * inf + 0.4 * rel) / (1 + dist), 9) AS score, coalesce(kth.rk, 0.0) AS rk FROM (SELECT r.u, r.p, rel, CASE WHEN coalesce(soc, 0) > 0 THEN 1 + pow(6.0, soc) ELSE 1.0 END AS inf, far.dist
        FROM (SELECT u, 0::bigint AS p, sum(idf) AS rel FROM user_term JOIN idf USING (term) WHERE term IN (SELECT term FROM poi_term WHERE p < 5) GROUP BY u HAVING sum(idf) > 0) r JOIN far USING (u, p) LEFT JOIN soc USING (u, p)) q LEFT JOIN kth USING (u)) WHERE score > rk""",
    ),
    "reverse_topk_group_keywords": _with(
        "user_term poi_term idf soc far kth ask",
        f"""SELECT {_RESULT} FROM (SELECT q.*, round((0.6 * inf + 0.4 * rel) / (1 + dist), 9) AS score, coalesce(kth.rk, 0.0) AS rk FROM (SELECT r.u, r.p, rel, CASE WHEN coalesce(soc, 0) > 0 THEN 1 + pow(6.0, soc) ELSE 1.0 END AS inf, far.dist
        FROM (SELECT u, ask.p, rel FROM (SELECT u, sum(idf) AS rel FROM user_term JOIN idf USING (term) WHERE term IN (SELECT term FROM poi_term WHERE p < 5) GROUP BY u HAVING sum(idf) > 0), ask) r JOIN far USING (u, p) LEFT JOIN soc USING (u, p)) q LEFT JOIN kth USING (u)) WHERE score > rk""",
    ),
    "reverse_topk_location": _with(
        "user_term idf kth users vu edge",
        f"""SELECT {_RESULT} FROM (SELECT q.*, round((0.6 * inf + 0.4 * rel) / (1 + dist), 9) AS score, coalesce(kth.rk, 0.0) AS rk FROM (SELECT r.u, -1::bigint AS p, rel, 1.0::double AS inf,
        CASE WHEN a.ni = b.ni AND a.nj = b.nj THEN abs(a.dis - b.dist / 2) WHEN a.ni = b.ni THEN a.dis + b.dist / 2 ELSE least(x.dist, y.dist) + b.dist / 2 END AS dist
        FROM (SELECT u, sum(idf) AS rel FROM user_term JOIN idf USING (term) WHERE term IN ('Brand#11', 'Brand#22') GROUP BY u HAVING sum(idf) > 0) r JOIN users a USING (u), edge b, vu x, vu y
        WHERE b.eid = 7 AND x.v = b.ni AND x.u = a.u AND y.v = b.nj AND y.u = a.u) q LEFT JOIN kth USING (u)) WHERE score > rk""",
    ),
    "vertex_term_kth": _with("poi_term idf vp", "SELECT v, term, round(score, 6) AS rk FROM (SELECT v, term, score, row_number() OVER (PARTITION BY v, term ORDER BY score DESC, p) AS r FROM (SELECT v, term, p, round(CASE WHEN idf > 0 THEN (0.6 + 0.4 * idf) / (1 + dist) ELSE 0 END, 9) AS score FROM poi_term JOIN idf USING (term) JOIN vp USING (p))) WHERE r = 3"),
    "gsk_score_indexed": _with("scored", "SELECT u, p, round(score, 6) AS score FROM scored"),
    "label_distance": _with("dd", "SELECT * FROM dd"),
    "spsp": _with("dd", "SELECT * FROM dd WHERE t = 24 - s"),
    "border_labels": _with(
        "dd leaf roads",
        """SELECT l::bigint AS level, dd.s AS v, dd.t AS hub, round(d, 6) AS d FROM dd JOIN leaf x ON x.v = dd.s JOIN leaf y ON y.v = dd.t, range(3) r(l) WHERE x.leaf >> (2 * l) = y.leaf >> (2 * l)
        AND (l = 0 OR dd.t IN (SELECT a FROM roads JOIN leaf p ON p.v = a JOIN leaf q ON q.v = b WHERE p.leaf >> (2 * (l - 1)) <> q.leaf >> (2 * (l - 1))))""",
    ),
    "drop_vertices": _with("edge", "SELECT ni, nj, dist FROM edge WHERE ni % 5 <> 2 AND nj % 5 <> 2"),
    "zipf_shares": _with("trank", "SELECT rank, round(sum(1.0::double / rank) OVER (ORDER BY rank) / (SELECT sum(1.0::double / rank) FROM trank), 6) AS cum FROM trank"),
    "first_terms": _with("poi_term", "SELECT p, array_to_string(list_slice(list_sort(list_distinct(list(term))), 1, 3), ',') AS terms FROM poi_term GROUP BY p"),
    "point_rectangles": _with(
        "vertex",
        "SELECT v, round(sqrt(pow(greatest(1 - x, 0, x - 2), 2) + pow(greatest(1 - y, 0, y - 3), 2)), 6) AS near, round(sqrt(pow(greatest(abs(x - 1), abs(x - 2)), 2) + pow(greatest(abs(y - 1), abs(y - 3)), 2)), 6) AS far FROM vertex",
    ),
    "reverse_cardinality": _with("rev", "SELECT p, count(*)::bigint AS n FROM rev WHERE p < 5 GROUP BY p"),
    "candidate_groups": _with("best", "SELECT p, count(*)::bigint AS n FROM best GROUP BY p"),
    "pois_of_terms": _with("poi_term", "SELECT DISTINCT p FROM poi_term WHERE term IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') ORDER BY p LIMIT 20"),
    "keyword_pool": _with("idf", "SELECT term, df FROM idf WHERE df > 1 AND df < 1000 ORDER BY term LIMIT 10"),
    "edge_prob_wc": _with("prob", "SELECT u, v, round(prob, 6) AS prob FROM prob"),
    "edge_prob_uniform": _with("und", "SELECT u, v, 0.05::double AS prob FROM und"),
    "edge_prob_trivalency": _with("und", f"SELECT u, v, ([0.001, 0.01, 0.1])[({_hash("'1|' || u || '|' || v")} % 3 + 1)::int]::double AS prob FROM und"),
    "live_edges": _with("live", "SELECT round, u, v FROM live"),
    "reachable_users": _with("reached", "SELECT node FROM reached"),
    "rr_users": _with("rr", "SELECT DISTINCT round, node FROM rr"),
    "rr_pois": _with("rr seeds", "SELECT DISTINCT round, p FROM rr JOIN seeds ON seeds.u = node"),
    "rr_pois_outer": _with("rr seeds", "SELECT DISTINCT round, p FROM (SELECT round, node, min(depth) AS depth FROM rr GROUP BY ALL) JOIN seeds ON seeds.u = node WHERE depth >= 2"),
    "greedy_step1_cover": _with("rr seeds", "SELECT p, count(DISTINCT round)::bigint AS gain FROM rr JOIN seeds ON seeds.u = node GROUP BY p"),
    "rr_cover": _with("rr seeds", "SELECT count(DISTINCT round)::bigint AS covered FROM rr JOIN seeds ON seeds.u = node WHERE p < 2"),
    "mc_spread_ic": _with("ic", f"SELECT round(count(*) / {ROUNDS}, 6) AS spread FROM (SELECT DISTINCT round, node FROM ic)"),
    "one_hop_spread": _with("onehop", "SELECT p, round(spread, 6) AS spread FROM onehop"),
    "one_hop_spread_outer": _with("onehop2", "SELECT p, round(spread, 6) AS spread FROM onehop2"),
    "mc_spread_lt": _with("lt40", f"SELECT round(count(*) / {ROUNDS}, 6) AS spread FROM lt40"),
    "junction_chains": _with("chain", "SELECT a0 AS a, b0 AS b, last AS \"end\", length FROM chain WHERE last = a0 OR last NOT IN (SELECT a FROM thin GROUP BY a HAVING count(*) = 2)"),
    "zipf_rewrite": _with(
        "poi_term zt np",
        f"""SELECT p, term FROM (SELECT p, term, target, row_number() OVER (PARTITION BY term ORDER BY {_hash("'1|zipf|' || p || '|' || term")}, p) AS rn FROM poi_term JOIN zt USING (term)) WHERE rn <= target
        UNION ALL SELECT p, term FROM (SELECT p, term, lack, row_number() OVER (PARTITION BY term ORDER BY i) AS rn FROM (SELECT term, lack, {_hash("'1|add|' || term || '|' || i")} % n AS p, min(i) AS i
        FROM (SELECT term, target - df AS lack, unnest(range(2 * (target - df) + 11)) AS i FROM zt WHERE target > df), np GROUP BY ALL) WHERE (p, term) NOT IN (SELECT (p, term) FROM poi_term)) WHERE rn <= lack""",
    ),
    "select_greedy_onehop": _with(
        "gp1 gp2 gp3",
        "SELECT 1::bigint AS step, p, round(spread, 6) AS gain FROM gp1 UNION ALL SELECT 2, gp2.p, round(gp2.spread - gp1.spread, 6) FROM gp2, gp1 UNION ALL SELECT 3, gp3.p, round(gp3.spread - gp2.spread, 6) FROM gp3, gp2",
    ),
    "select_celf": _with("celf1 celf2 celf3", _steps("celf")),
    "select_pmc": _with("pmc1 pmc2 pmc3", _steps("pmc")),
    "select_cardinality": _with("rev", "SELECT p, count(*)::bigint AS n FROM rev WHERE p < 5 GROUP BY p ORDER BY n DESC, p LIMIT 3"),
    "select_relevance": _with("rel far", "SELECT p, count(DISTINCT u)::bigint AS n FROM rel JOIN far USING (u, p) WHERE p < 5 AND dist < 20 GROUP BY p ORDER BY n DESC, p LIMIT 3"),
    "select_influencer": _with("rev prob", "SELECT p, count(*)::bigint AS n FROM rev WHERE p < 5 AND u IN (SELECT u FROM (SELECT u, sum(prob) AS s FROM prob GROUP BY u) WHERE u IN (SELECT u FROM rev WHERE p < 5) ORDER BY round(s, 9) DESC, u LIMIT 201) GROUP BY p ORDER BY n DESC, p LIMIT 3"),
    "select_random": f"SELECT s_suppkey::bigint AS p FROM supplier ORDER BY {_hash("'1|poi|' || s_suppkey")}, s_suppkey LIMIT 5",
}
