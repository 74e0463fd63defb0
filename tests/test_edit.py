"""Edits, unrolled cycles, strands, layouts and chunks of long paths, on small graphs and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from braidframe import model
from braidframe.model import EDGE_SCHEMA, NODE_SCHEMA, PATH_SCHEMA, STEP_SCHEMA, Graph, edges_of_steps
from braidframe.operators import edit as E
from braidframe.operators import normalise as N
from braidframe.operators import sampling as P
from braidframe.operators import stats as S
from braidframe.operators import traverse as T


def graph(spark, seqs, walks):
    """Nodes 1, 2, ... with ``seqs``; ``walks`` are lists of node ids, negative where reversed."""
    nodes = spark.createDataFrame([(i, s, len(s), i) for i, s in enumerate(seqs, 1)], NODE_SCHEMA)
    steps = spark.createDataFrame([(p, k, abs(n), n < 0) for p, w in enumerate(walks, 1) for k, n in enumerate(w)], STEP_SCHEMA)
    paths = spark.createDataFrame([(p, f"p{p}", False) for p in range(1, len(walks) + 1)], PATH_SCHEMA)
    return Graph(nodes, edges_of_steps(steps).drop("support"), paths, steps)


def walk(g, path):
    return [-r.node_id if r.is_rev else r.node_id for r in g.steps.filter(F.col("path_id") == path).orderBy("step_rank").collect()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments(spark):
    g = graph(spark, ["A"] * 6, [[1, 2, 3, 4], [5]])
    seg = lambda *r: spark.createDataFrame(list(r), "path_id long, first long, last long")
    new = lambda *r: spark.createDataFrame(list(r), "path_id long, first long, k int, node_id long, is_rev boolean")
    assert walk(E.rewrite_segments(g, seg((1, 1, 3)), new((1, 1, 1, 6, False), (1, 1, 0, 5, True))), 1) == [1, -5, 6, 4]
    assert walk(E.rewrite_segments(g, seg((1, 2, 2)), new((1, 2, 0, 6, False))), 1) == [1, 2, 6, 3, 4]
    cut = E.rewrite_segments(g, seg((1, 0, 1), (1, 3, 4)))
    assert walk(cut, 1) == [2, 3] and walk(cut, 2) == [5]
    more = spark.createDataFrame([(1, 0, 6, False), (1, 1, 5, True), (2, 0, 1, False)], "path_id long, k int, node_id long, is_rev boolean")
    assert walk(E.append_steps(g, more), 1) == [1, 2, 3, 4, 6, -5]
    assert walk(E.prepend_steps(g, more), 2) == [1, 5]
    assert rows(E.rewrite_segments(g, seg()).steps) == rows(g.steps)


def test_nodes_edges_and_paths(spark):
    g = graph(spark, ["AC", "G"], [[1, 2]])
    h = E.add_nodes(g, spark.createDataFrame([(9, "TT"), (2, "CCC"), (9, "TT")], "node_id long, seq string"))
    assert rows(h.nodes) == [(1, "AC", 2, 1), (2, "G", 1, 2), (9, "TT", 2, 3)]
    h = E.set_sequences(h, spark.createDataFrame([(2, "NN"), (7, "A")], "node_id long, seq string"))
    assert rows(h.nodes.filter("node_id = 2")) == [(2, "NN", 2, 2)]
    one = spark.createDataFrame([(9, True, 2, True), (1, False, 2, False)], EDGE_SCHEMA)
    assert rows(E.add_edges(h, one).edges) == [(1, False, 2, False), (2, False, 9, False)]
    assert rows(E.drop_edges(h, spark.createDataFrame([(2, True, 1, True)], EDGE_SCHEMA)).edges) == []
    p = spark.createDataFrame([("p1", False), ("q", True)], "path_name string, is_circular boolean")
    s = spark.createDataFrame([("q", 5, 9, True), ("q", 2, 1, False), ("p1", 0, 1, False)], "path_name string, k int, node_id long, is_rev boolean")
    h = E.add_paths(h, p, s)
    assert rows(h.paths) == [(1, "p1", False), (2, "q", True)] and walk(h, 2) == [1, -9] and walk(h, 1) == [1, 2]
    h = E.set_circular(h, spark.createDataFrame([(1, True)], "path_id long, is_circular boolean"))
    assert rows(h.paths) == [(1, "p1", True), (2, "q", True)]
    h = E.shift_ids(h, 10)
    assert walk(h, 2) == [11, -19] and h.id_bounds() == (11, 19)
    empty = graph(spark, ["A"], [[1]]).with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0), paths=g.paths.limit(0), steps=g.steps.limit(0))
    assert E.add_nodes(empty, spark.createDataFrame([(3, "A")], "node_id long, seq string")).nodes.first().node_rank == 1


def test_combine_only_where_asked(spark):
    g = graph(spark, ["AC", "G", "TT"], [[1, 2, 3]])
    links = spark.createDataFrame([(2, True, 1, True)], "a long, a_rev boolean, b long, b_rev boolean")
    h = E.combine(g, links)
    assert sorted(r.seq for r in h.nodes.collect()) == ["ACG", "TT"] and rows(S.fasta(h)) == rows(S.fasta(g))


def test_accessors(spark):
    g = graph(spark, ["AC", "G", "TT"], [[1, -2, 3], [3]])
    assert g.counts() == {"nodes": 3, "edges": 2, "paths": 2, "steps": 4}
    ids = spark.createDataFrame([(1,), (8,)], "node_id long")
    assert rows(g.has_nodes(ids)) == [(1,)] and len(g.steps_on(ids).collect()) == 1
    e = spark.createDataFrame([(2, False, 1, True), (1, False, 3, False)], "src long, src_rev boolean, dst long, dst_rev boolean")
    assert rows(g.has_edges(e)) == [(2, False, 1, True)]
    names = spark.createDataFrame([("p2",), ("x",)], "name string")
    assert rows(g.has_paths(names)) == [("p2",)] and [r.node_id for r in g.steps_of(names).collect()] == [3]
    at = spark.createDataFrame([(2, True)], "src long, src_rev boolean")
    assert [(r.dst, r.dst_rev) for r in g.follow(at).collect()] == [(3, False)]
    assert [(r.dst, r.dst_rev) for r in g.follow(at, left=True).collect()] == [(1, False)]
    assert rows(g.path_ends()) == [(1, 1, 3), (2, 3, 3)]


def test_long_paths_in_chunks(spark, monkeypatch):
    r = random.Random(3)
    seqs = ["A" * r.randint(0, 4) for _ in range(9)]
    g = graph(spark, seqs, [[r.choice((1, -1)) * r.randint(1, 9) for _ in range(n)] for n in (1, 3, 4, 8, 9, 23)])
    want = rows(g.positions().select("path_id", "step_rank", "step_start", "step_end")), rows(g.transitions()), rows(edges_of_steps(g.steps))
    monkeypatch.setattr(model, "CHUNK", 4)
    assert (rows(g.positions().select("path_id", "step_rank", "step_start", "step_end")), rows(g.transitions()), rows(edges_of_steps(g.steps))) == want
    at = 0
    for n, s in zip(walk(g, 6), [x for x in rows(g.positions().select("path_id", "step_rank", "step_start")) if x[0] == 6]):
        assert s[2] == at
        at += len(seqs[abs(n) - 1])


def test_unrolled_graph_keeps_walks(spark):
    g = graph(spark, ["A", "C", "G", "T", "AA"], [[1, 2, 3, 4, 2, 3, 5], [4, 4]])
    h, c = N.dagify(g, 6)
    assert N.is_acyclic(h)
    old = {r.node_id: r.old_id for r in c.collect()}
    seq = {r.node_id: r.seq for r in h.nodes.collect()}
    ways, was = {}, {}
    for r in T.forward_edges(h).collect():
        ways.setdefault(r.src, []).append(r.dst)
    for r in T.forward_edges(g).collect():
        was.setdefault(r.src, []).append(r.dst)

    def walks(start, on, name, size, length):
        out, stack = set(), [((name(start),), start, 0)]
        while stack:
            w, at, bp = stack.pop()
            out.add(w)
            if bp + size(at) < length:
                stack += [(w + (name(n),), n, bp + size(at)) for n in on.get(at, [])]
        return out

    base = {n: len(s) for n, s in enumerate(["A", "C", "G", "T", "AA"], 1)}
    for n in base:
        want = walks(n, was, lambda x: x, base.get, 6)
        got = set()
        for k in (k for k in old if old[k] == n):
            got |= walks(k, ways, old.get, lambda x: len(seq[x]), 6)
        assert got == want


def test_strands(spark):
    g = graph(spark, ["A"] * 6, [[1, -2, -3], [4, 5, -4]])
    assert rows(T.single_strand_flips(g).filter("flip IS NOT NULL")) == [(1, False), (2, True), (3, True), (6, False)]
    f = N.flipped(g, T.single_strand_flips(g))
    assert f.edges.filter("from_rev != to_rev AND from_id < 4 AND to_id < 4").count() == 0
    t = g.paths.filter("path_id = 1").select("path_id")
    assert {r.node_id: r.flip for r in T.groom(g, t).collect()}[3] is True


def test_order_by_distance_along_paths(spark):
    r = random.Random(5)
    order = list(range(1, 31))
    r.shuffle(order)
    g = graph(spark, ["ACGT"] * 30, [order, order[5:25]])
    got = {x.node_id: x.new_rank for x in P.path_sgd(g, 16, 4).collect()}
    place = [got[n] for n in order]
    same = sum((place[i] < place[j]) for i in range(30) for j in range(i + 1, 30)) / 435
    assert same > 0.9
    held = g.paths.filter("path_id = 2").select("path_id")
    start = {x.node_id: float(x.pan_start) for x in g.pan_positions().collect()}
    x = {r.node_id: r.x for r in P.path_sgd(g, 4, 2, frozen=held).collect()}
    assert all(x[n] == start[n] for n in order[5:25]) and any(x[n] != start[n] for n in order[:5])


def test_feedback_arcs(spark):
    g = graph(spark, ["A"] * 8, [[1, 2, 3, 4], [3, 2], [5, 6, 7, 5]])
    place = {r.node_id: (r.component, r.place) for r in P.feedback_arc_order(g).collect()}
    assert set(place) == set(range(1, 9)) and place[8] == (8, 0)
    assert sorted(p for c, p in place.values() if c == 1) == [0, 1, 2, 3] and place[1][1] == 0 and place[4][1] == 3
    back = [(r.src, r.dst) for r in T.forward_edges(g, loops=False).collect() if place[r.src][1] > place[r.dst][1]]
    assert len(back) == 2
    # a graph without cycles has no arc back
    d = graph(spark, ["A"] * 6, [[6, 2, 4], [6, 3, 4, 1], [2, 3, 5]])
    at = {r.node_id: r.place for r in P.feedback_arc_order(d).collect()}
    assert all(at[r.src] < at[r.dst] for r in T.forward_edges(d).collect())


@pytest.mark.parametrize("theta", [0.5, 0.99, 1.5])
def test_zipf_jumps(spark, theta):
    space = 20
    d = spark.range(20000).select(P.zipf_jump((F.col("id") + 0.5) / 20000, theta, F.lit(space)).alias("j")).groupBy("j").count()
    n = {r.j: r["count"] for r in d.collect()}
    assert set(n) == set(range(1, space + 1)) and all(n[i] >= n[i + 1] for i in range(1, space))
    assert abs(n[1] / n[10] - (((2 ** (1 - theta)) - 1) / (11 ** (1 - theta) - 10 ** (1 - theta)))) < 0.5


def test_stacked_layout(spark):
    g = graph(spark, ["A"] * 4, [[1, 2], [3]])
    at = spark.createDataFrame([(1, 5.0, 2.0), (2, 7.0, 4.0), (3, 1.0, 1.0), (4, 0.0, 9.0)], "node_id long, x double, y double")
    assert rows(N.stacked(g, at)) == [(1, 1, 0.0, 0.0), (2, 1, 2.0, 2.0), (3, 3, 0.0, 3.0), (4, 4, 0.0, 4.0)]
