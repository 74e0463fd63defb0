"""Known results on the small fixture graph: ten nodes, eleven edges, four paths, a self-loop and an isolated node."""

import pytest
from pyspark.sql import functions as F

from braidframe.operators import intervals as I
from braidframe.operators import rewrite as R
from braidframe.operators import sampling as P
from braidframe.operators import stats as S
from braidframe.operators import traverse as T
from braidframe.sources import gfa, sinks

#: A graph with a node that loops onto itself and one without edges.
GFA = """H\tVN:Z:1.0
S\t1\tCAA
S\t2\tA
S\t3\tG
S\t4\tT
S\t5\tC
S\t6\tTTG
S\t7\tA
S\t8\tGAT
S\t9\tGTC
S\t10\tCATG
P\ttarget\t3+,5+,6+,6+,8+,9+\t*
P\tquery1\t2+,4+,6+,7+\t*
P\tquery2\t10+\t*
P\tquery3\t1+,2+,5+,6+,8+,9+\t*
L\t1\t+\t2\t+\t0M
L\t1\t+\t3\t+\t0M
L\t2\t+\t4\t+\t0M
L\t2\t+\t5\t+\t0M
L\t3\t+\t5\t+\t0M
L\t4\t+\t6\t+\t0M
L\t5\t+\t6\t+\t0M
L\t6\t+\t6\t+\t0M
L\t6\t+\t7\t+\t0M
L\t6\t+\t8\t+\t0M
L\t8\t+\t9\t+\t0M
"""


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("gfa") / "small.gfa"
    p.write_text(GFA)
    return gfa.read_gfa(spark, str(p))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_degree(g):
    d = dict((r.node_id, r.degree) for r in S.degree_table(g).collect())
    assert [d[i] for i in range(1, 11)] == [2, 3, 2, 2, 3, 6, 1, 2, 1, 0]
    assert tuple(S.degree_summary(g).first()) == (10, 11, 2.2, 0, 6)


def test_mean_degree(g):
    m = I.mean_over_paths(g, S.degree_table(g), "degree").join(g.paths, "path_id")
    got = {r.path_name: (r.start, r.end, round(r["mean"], 5)) for r in m.collect()}
    assert got == {"target": (0, 14, 3.57143), "query1": (0, 6, 4.0), "query2": (0, 4, 0.0), "query3": (0, 14, 2.78571)}


def test_invariants(g):
    d = S.depth_table(g).join(g.nodes, "node_id")
    assert d.agg(F.sum(F.col("depth") * F.col("len"))).first()[0] == g.path_lengths().agg(F.sum("path_len")).first()[0]
    assert S.degree_table(g).agg(F.sum("degree")).first()[0] == 2 * g.edges.count()
    assert S.invalid_steps(g).count() == 0
    sim = I.similarity(g, "#", 1)
    assert {r.jaccard for r in sim.filter("group_a = group_b").collect()} == {1.0}
    assert rows(sim.select("group_a", "group_b", "intersection")) == rows(sim.select("group_b", "group_a", "intersection"))


def test_windows_partition_every_path(g):
    v = S.degree_table(g)
    both = I.windows(g, v, "degree", 2, 3).union(I.windows(g, v, "degree", 2, 3, out=True))
    assert rows(both.groupBy("path_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))) == rows(g.path_lengths().select("path_id", "path_len"))


def test_path_sequences_survive_rewrites(g):
    want = rows(S.fasta(g))
    for h in (R.chop(g, 2), T.unchop(g), T.unchop(R.chop(g, 1))):
        assert rows(S.fasta(h)) == want
        assert S.invalid_steps(h).count() == 0


def test_unchop_of_chopped_graph(g):
    assert T.unchop(R.chop(g, 1)).nodes.count() == T.unchop(g).nodes.count()


def test_round_trip(spark, g, tmp_path):
    gfa.write_gfa(g, str(tmp_path / "out"))
    h = gfa.read_gfa(spark, str(tmp_path / "out"))
    assert rows(h.nodes.select("node_id", "seq")) == rows(g.nodes.select("node_id", "seq"))
    assert rows(h.edges) == rows(g.edges)
    assert rows(S.fasta(h)) == rows(S.fasta(g))
    gfa.save(g, str(tmp_path / "tables"))
    assert rows(gfa.open_graph(spark, str(tmp_path / "tables")).steps) == rows(g.steps)
    assert {r.line_type: r.n for r in gfa.line_types(spark, str(tmp_path / "out")).collect()} == {"H": 1, "S": 10, "L": 11, "P": 4}


def test_bad_graphs(spark, tmp_path):
    for text in ("S\ta\tC\n", "S\t1\tC\nS\t1\tA\n", "S\t1\tC\nL\t1\t+\t2\t+\t0M\n"):
        p = tmp_path / "bad.gfa"
        p.write_text(text)
        with pytest.raises(gfa.GraphError):
            gfa.read_gfa(spark, str(p))


def test_reverse_steps_and_flip(spark, tmp_path):
    p = tmp_path / "r.gfa"
    p.write_text("S\t1\tAAC\nS\t2\tG\nP\tp\t2-,1-\t*\nL\t1\t+\t2\t+\t0M\n")
    h = gfa.read_gfa(spark, str(p))
    assert rows(S.fasta(h)) == [("p", "CGTT")]
    f = R.flip_paths(h)
    assert rows(S.fasta(f)) == [("p_inv", "AACG")]
    assert S.invalid_steps(f).count() == 0


def test_inverting_loop_counts_once(spark, tmp_path):
    p = tmp_path / "i.gfa"
    p.write_text("S\t1\tA\nL\t1\t+\t1\t-\t0M\n")
    assert S.degree_table(gfa.read_gfa(spark, str(p))).first().degree == 1


def test_groom_turns_a_reversed_node(spark, tmp_path):
    p = tmp_path / "g.gfa"
    p.write_text("S\t1\tA\nS\t2\tC\nS\t3\tG\nL\t1\t+\t2\t-\t0M\nL\t2\t-\t3\t+\t0M\n")
    assert rows(T.groom(gfa.read_gfa(spark, str(p)))) == [(1, False), (2, True), (3, False)]


def test_sinks(g):
    r = I.windows(g, S.degree_table(g), "degree", 2, 3)
    assert all(x.line.count("\t") == 2 for x in sinks.bed_lines(r, g).collect())
    f = sinks.fasta_lines(S.fasta(g), 5).filter("path_name = 'target'").orderBy("k").collect()
    assert [x.line for x in f] == [">target", "GCTTG", "TTGGA", "TGTC"]
    assert "nodes: 10" in [x.line for x in sinks.yaml_lines(S.summary(g)).collect()]


def test_context_and_shortest_paths(g):
    seeds = g.nodes.filter("node_id = 7")
    assert {r.node_id: r.hops for r in T.reach(g, seeds, 2).collect()} == {7: 0, 6: 1, 4: 2, 5: 2, 8: 2}
    d = {(r.node_id, r.is_rev): r.dist for r in T.shortest_paths(g, 1).collect()}
    assert d[(6, False)] == 2 and d[(9, False)] == 8


def test_steps_of_one_group_count_in_pav(g, spark):
    r = g.paths.filter("path_name = 'target'").select("path_id", F.lit(0).cast("long").alias("start"), F.lit(14).cast("long").alias("end"), F.lit("t").alias("name"))
    p = {x.grp: x.pav for x in I.presence(g, r).collect()}
    assert p["target"] == 1.0 and p["query3"] == 13 / 14 and "query2" not in p


def test_private_walks_start_anywhere(spark):
    import hashlib
    import math

    from braidframe.model import PATH_SCHEMA, Graph, edges_of_steps

    n = 2500
    nodes = spark.range(1, n + 1).select(F.col("id").alias("node_id"), F.lit("A").alias("seq"), F.lit(1).cast("long").alias("len"), F.col("id").alias("node_rank"))
    steps = spark.range(2 * n).select((F.floor(F.col("id") / 2) + 1).alias("path_id"), (F.col("id") % 2).alias("step_rank"), (F.floor((F.col("id") + F.col("id") % 2) / 2) % n + 1).alias("node_id"), F.lit(False).alias("is_rev"))
    g = Graph(nodes, edges_of_steps(steps).drop("support"), spark.createDataFrame([], PATH_SCHEMA), steps)

    def noise(walk, node):
        u = (int(hashlib.sha256(f"priv|{walk}|0|{node}|false".encode()).hexdigest()[:12], 16) + 1) / (16.0**12 + 2)
        return -math.log(-math.log(u))

    want = [max(range(1, n + 1), key=lambda i: noise(w, i)) for w in range(12)]
    got = {r.walk: r.node_id for r in P.private_haplotypes(g, 12, 1).collect()}
    assert [got[w] for w in range(12)] == want and max(want) > 1000
    assert P.private_haplotypes(g, 0, 1).count() == 0
