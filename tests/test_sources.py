"""Readers and text writers over small files, with the cases that a file may hold."""

import json
import math

import pytest

from braidframe.operators import intervals as I
from braidframe.operators import stats as S
from braidframe.sources import gfa, intervals, sinks

GFA = "S\t1\tAAC\nS\t2\tG\nP\ta#1:100-104\t1+,2+\t*\nP\tb\t2-,1-\t*\nP\tnone\t\t*\nL\t1\t+\t2\t+\t0M\n"


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("src") / "g.gfa"
    p.write_text(GFA)
    return gfa.read_gfa(spark, str(p))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def written(tmp_path, text):
    p = tmp_path / "in.txt"
    p.write_text(text)
    return str(p)


def test_lists_and_groups(spark, tmp_path):
    assert rows(intervals.read_list(spark, written(tmp_path, "b\n\na\nb\n a \n"))) == [("a",), ("b",)]
    assert rows(intervals.read_groups(spark, written(tmp_path, "a\tx\nb\n\na\tx\n"))) == [("a", "x"), ("b", "b")]


@pytest.mark.parametrize(("text", "want"), [("a", ("a", None, None)), ("a:5", ("a", 5, None)), ("a:5-9", ("a", 5, 9)), ("s#1:2-4:5-9", ("s#1:2-4", 5, 9)), ("a:x", ("a:x", None, None))])
def test_region(text, want):
    assert intervals.region(text) == want


def test_bed(spark, g, tmp_path):
    text = "#head\nb\t1\t3\tx\t0\t-\nb\nb\t2\t2\nunknown\t0\t1\n\na#1:100-104\t2\n"
    assert rows(intervals.read_bed(spark, written(tmp_path, text), g)) == [("a#1:100-104", 2, 4, "", False), ("b", 0, 4, "", False), ("b", 1, 3, "x", True)]


def test_gff(spark, tmp_path):
    text = "##gff\na#1:100-104\t.\tgene\t102\t110\t.\t+\t.\tID=g\na#1:100-104\t.\tgene\t1\t50\t.\t+\t.\tID=before\nb\t.\tgene\t2\t3\t.\t+\t.\tID=h\n"
    assert rows(intervals.read_gff(spark, written(tmp_path, text))) == [("a#1:100-104", 1, 4, "ID=g"), ("b", 1, 3, "ID=h")]


def test_contained_ranges(spark, g):
    r = spark.createDataFrame([("a#1", 101, 103, "in"), ("a#1", 99, 103, "over"), ("b", 0, 1, "no")], "base string, start long, end long, name string")
    assert rows(I.contained(r, g)) == [("a#1:100-104", 1, 3, "in")]


def test_match_lines(spark, g):
    m = spark.createDataFrame([(1, 0, 4, 2, 1, 4, 0.5, "-", 1.0, 1)], "query long, query_start long, query_end long, ref long, ref_start long, ref_end long, score double, inv string, self_cov double, nth_best long")
    assert sinks.bedpe_lines(m).first().line == "1\t0\t4\t2\t1\t4\t0.5\t-\t1.0\t1"
    f = sinks.paf_lines(m, g.path_lengths()).first().line.split("\t")
    identity = 1 - min(1.0, -math.log(2 * 0.5 / 1.5))
    assert f[:9] == ["1", "4", "0", "4", "-", "2", "4", "1", "4"] and f[9:12] == [str(round(4 * identity)), "4", "255"]
    assert f[12] == f"id:f:{identity:.6f}" and f[13] == "jc:f:0.500000"
    assert [r.line for r in sinks.gggenes_lines(m).collect()] == ["molecule\tgene\tstart\tend\tstrand", "1\t2\t0\t4\t0"]


def test_sequence_lines(g):
    q = {r.line for r in sinks.fastq_lines(S.fasta(g)).collect()}
    assert q == {"@a#1:100-104\nAACG\n+\nIIII", "@b\nCGTT\n+\nIIII"}


def test_bins_as_json(g):
    lines = [json.loads(r.line) for r in sinks.json_lines(I.bins(g, 2)).collect()]
    assert {x["path_id"]: [b["bin"] for b in x["bins"]] for x in lines} == {1: [0, 1], 2: [0, 1]}


def test_components_as_files(spark, g, tmp_path):
    out = str(tmp_path / "parts")
    sinks.write_components(g, out)
    h = gfa.read_gfa(spark, f"{out}/component=1")
    assert rows(h.nodes) == rows(g.nodes) and rows(S.fasta(h)) == rows(S.fasta(g))


def test_layout_round_trip(spark, tmp_path):
    at = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.0, -3.0)], "node_id long, x double, y double")
    sinks.write_layout(at, str(tmp_path / "lay"))
    assert rows(sinks.read_layout(spark, str(tmp_path / "lay"))) == rows(at)
