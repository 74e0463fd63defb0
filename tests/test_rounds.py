"""What loops and rewrites leave behind and what they spell out."""

import time

import pytest
from pyspark.sql import functions as F

from braidframe.model import EDGE_SCHEMA
from braidframe.operators import intervals as I
from braidframe.operators import normalise as N
from braidframe.operators import traverse as T
from braidframe.plans import loops
from test_edit import graph, rows


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(loops, "FALLBACK", str(tmp_path))
    return tmp_path


def tables(folder):
    return sum(p.name.startswith("round-") for p in folder.iterdir())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def line(spark, n):
    return graph(spark, ["A"] * n, [list(range(1, n + 1))])


def test_rounds_free_their_shuffles(spark, folder):
    before = shuffle_files(spark)
    loops.checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


@pytest.mark.parametrize("make, most", [(T.components, 1), (T.single_strand_flips, 1), (lambda g: T.chains(g), 2), (lambda g: T.distance_to_ends(g), 1), (lambda g: T.reach(g, g.nodes.filter("node_id = 1"), 99), 16), (T.groom, 17)])
def test_old_rounds_go(spark, folder, make, most):
    g = line(spark, 40)
    assert make(g).count() == 40
    assert tables(folder) <= most


def test_chains_and_rings(spark):
    g = graph(spark, ["A"] * 9, [])
    e = [(3, False, 2, False), (2, False, 5, True), (7, False, 8, False), (8, False, 9, False), (9, False, 7, False), (4, False, 4, True)]
    g = g.with_(edges=spark.createDataFrame(e, EDGE_SCHEMA))
    got = {r.node_id: (r.chain, r.is_rev, r.pos) for r in T.chains(g).collect()}
    assert sorted(got) == list(range(1, 10))
    assert got[1] == (1, False, 0) and got[4] == (4, False, 0) and got[6] == (6, False, 0)
    assert [got[n] for n in (3, 2, 5)] == [(3, False, 0), (3, False, 1), (3, True, 2)]
    assert [got[n] for n in (8, 9, 7)] == [(8, False, 0), (8, False, 1), (8, False, 2)]


def test_range_totals(spark):
    g = graph(spark, ["A" * (n % 4) for n in range(30)], [[3, 9, 4], [20, 11], [1, 30, 2]])
    r = spark.createDataFrame([(1, 0, 99, "a"), (2, 0, 1, "b"), (3, 1, 99, "c")], "path_id long, start long, end long, name string")
    want = N.split_extract(g, r, full_range=True).join(g.lengths(), "node_id").groupBy("name").agg(F.count("*"), F.sum("len"))
    assert rows(N.range_totals(g, r)) == rows(want)


def test_presence_with_cut_lists(spark, folder, monkeypatch):
    """A node's groups come in lists, which are cut where they are long."""
    monkeypatch.setattr(I, "GROUPS", 2)
    g = graph(spark, ["AC", "G", "TTT"], [[1, 2], [2, 3], [3], [1, 2, 3], [2]])
    r = spark.createDataFrame([(1, 0, 3, "a"), (2, 0, 4, "b"), (4, 2, 3, "c")], "path_id long, start long, end long, name string")
    got = {(x.name, x.grp): round(x.pav, 6) for x in I.presence(g, r).collect()}
    on = {"a": {"p1": 1, "p2": 1 / 3, "p4": 1, "p5": 1 / 3}, "b": {"p1": 0.25, "p2": 1, "p3": 0.75, "p4": 1, "p5": 0.25}, "c": {"p1": 1, "p2": 1, "p4": 1, "p5": 1}}
    assert got == {(n, p): round(v, 6) for n, x in on.items() for p, v in x.items()}


def test_untangle_in_slices(spark, folder, monkeypatch):
    """Queries dealt into slices match as those that are joined at once."""
    from braidframe.operators import liftover as L

    g = graph(spark, ["ACG", "GT", "TTT", "CA"], [[1, 2, 3, 4], [2, 3, 1], [-3, -2, 4, 4], [1, 4]])
    whole = rows(L.untangle(g, g.paths, g.paths, 4, 2, 0.1))
    monkeypatch.setattr(L, "PAIRS_AT_ONCE", 5)
    assert whole and rows(L.untangle(g, g.paths, g.paths, 4, 2, 0.1)) == whole
