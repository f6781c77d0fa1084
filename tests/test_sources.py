"""Text formats read and written, stored indexes, the stream of check-ins, and the command line's choices."""

import os

import pytest

from tidemark import cli
from tidemark.operators import ranking, road
from tidemark.operators.border_index import border_index
from tidemark.sources import store, text
from tidemark.sources.files import TextDomain
from tidemark.sources.fixtures import Domain
from tidemark.streaming.checkins import read_checkin_stream, running_counts

DATA = "/root/testdata/sf0.001"


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_readers(spark, tmp_path):
    edges = text.read_edges(spark, put(tmp_path, "e", "0 3 1 5\n\n1 1  2\t7\n2 9 1 1\n"), most_vertex=5).collect()
    assert sorted(tuple(r) for r in edges) == [(0, 1, 3, 5.0), (1, 1, 2, 7.0)]
    places = text.read_places(spark, put(tmp_path, "u", "1 0 1 4.0 1.5 7 9 9 -1\n2 0 1 4 0 -1\n")).collect()
    assert [(r["u"], r["dis"], r["terms"]) for r in places] == [(1, 1.5, [7, 9, 9]), (2, 0.0, [])]
    assert text.inverted_index(text.read_places(spark, str(tmp_path / "u")), "u").count() == 2
    assert text.read_weighted(spark, put(tmp_path, "w", "3 2\n0 1 0.5\n1 1 0.9\n1 2 0\n"), 0.5).collect()[0]["prob"] == 0.25
    assert text.read_checkins(spark, put(tmp_path, "c", "1 2 3\n9 2 1\n"), most_poi=5).count() == 1
    assert text.read_options(spark, put(tmp_path, "o", "# x : y\nrounds : 10\n")) == {"rounds": "10"}
    v, e = text.read_dimacs(spark, put(tmp_path, "gr", "c x\na 1 2 5\n"), put(tmp_path, "co", "v 1 10 20\n"))
    assert tuple(v.first()) == (1, 10.0, 20.0) and tuple(e.first()) == (1, 2, 5.0)


def test_writers_and_places_on_graph(spark, tmp_path):
    e = spark.createDataFrame([(0, 0, 1, 4.0), (1, 1, 2, 6.0)], "eid long, ni long, nj long, dist double")
    v = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "v long, x double, y double")
    text.write_lines(e, str(tmp_path / "edge"), "eid", "ni", "nj", "dist")
    assert text.read_edges(spark, str(tmp_path / "edge")).count() == 2
    text.write_dimacs(v, e, str(tmp_path / "d"))
    back = text.read_dimacs(spark, str(tmp_path / "d" / "gr"), str(tmp_path / "d" / "co"))
    assert back[0].count() == 3 and back[1].count() == 4
    text.write_ddsg(v, e, str(tmp_path / "g"))
    text.write_tsv(e, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "g" / "1-edges")).count() == 2 and spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 2
    places = spark.createDataFrame([(1, 0, 1, 9.0, 5.0), (2, 3, 8, 2.0, 1.0)], "u long, ni long, nj long, dist double, dis double")
    got = {r["u"]: (r["ni"], r["nj"], r["dist"], r["dis"]) for r in text.on_graph(places, e, 3).collect()}
    assert got == {1: (0, 1, 4.0, 4.0), 2: (0, 1, 4.0, 1.0)}


def test_text_files_to_answer(spark, tmp_path):
    """Scores and choices from text files, by the index and by all pairs."""
    n = 5
    put(tmp_path, "g.cnode", "".join(f"{i} {i % n} {i // n}\n" for i in range(n * n)))
    ends = [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * n - n)]
    put(tmp_path, "g.cedge", "".join(f"{e} {a} {b} {3 + (a + b) % 4}\n" for e, (a, b) in enumerate([*ends, (3, 3), ends[0]])))
    put(tmp_path, "g.user", "".join(f"{u} {ends[u % 40][0]} {ends[u % 40][1]} 3 1.0 {u % 4} {u % 7 + 4} -1\n" for u in range(60)))
    put(tmp_path, "g.poi", "".join(f"{p} {ends[3 * p][0]} {ends[3 * p][1]} 3 2.0 {p % 4} {p % 3 + 4} {p % 3 + 4} -1\n" for p in range(8)))
    put(tmp_path, "g.friendship", "".join(f"{u} {(7 * u + 3) % 60}\n" for u in range(60)))
    put(tmp_path, "g.checkin", "".join(f"{u % 8} {u} {u % 3 + 1}\n" for u in range(60)))
    d = TextDomain(spark, str(tmp_path), "g", 3)
    assert d.road_edge.count() == 40 and d.n_users == 60 and d.n_pois == 8 and [r["p"] for r in d.query_poi.orderBy("p").collect()] == [0, 1, 2, 3, 4]
    by = [ranking.reverse_topk(ranking.Scores(d, x).scored(), d.query_poi, 3) for x in (road.apsp(d.road_vertex, d.road_edge), border_index(d.road_vertex, d.road_edge))]
    one, two = ({(r["p"], r["u"], r["score"]) for r in x.collect()} for x in by)
    assert one == two and len(one) > 20
    got = cli.choose(d, "cardi", 3, 0.6, 2, 0.1, 5, border_index(d.road_vertex, d.road_edge))
    assert len(set(got.pois)) == 2
    put(tmp_path, "g.query", "6\n7\n")
    assert TextDomain(spark, str(tmp_path), "g").query_poi.count() == 2
    assert [tuple(r) for r in text.read_pairs(spark, put(tmp_path, "m", "4 9\n"), "u", "most").collect()] == [(4, 9)]
    leaves = road.partition(d.road_vertex).withColumnRenamed("v", "id")
    text.write_by_leaf(leaves, str(tmp_path / "leaves"))
    assert spark.read.parquet(str(tmp_path / "leaves")).count() == 25


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3), (1, 4, 1), (2, 2, 1)], "p long, u long, cnt long").write.parquet(str(tmp_path / "in"))
    q = running_counts(read_checkin_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert {(r["p"], r["visits"]) for r in spark.table("counts").collect()} == {(1, 4), (2, 1)}
    finally:
        q.stop()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_indexes_and_choices(spark, tmp_path):
    domain = Domain(spark, DATA)
    store.build_indexes(domain, str(tmp_path / "ix"))
    assert store.read_index(spark, str(tmp_path / "ix"), "apsp").count() == 625
    old = store.read_index(spark, str(tmp_path / "ix"), "checkin")
    new = store.upsert(old, old.limit(1).selectExpr("p", "u", "cnt + 5 AS cnt"), ["p", "u"], str(tmp_path / "ix2"))
    assert new.count() == old.count()
    assert store.remove(new, new.limit(3), ["p", "u"], str(tmp_path / "ix3")).count() == old.count() - 3
    for algorithm in ("random", "rele", "cardi", "influ"):
        got = cli.choose(domain, algorithm, 3, 0.6, 2, 0.3, 5)
        assert len(got.pois) == len(set(got.pois)) == 2
