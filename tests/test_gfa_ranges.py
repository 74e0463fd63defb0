"""The byte-range source and the sink against the line reader, with ranges of a few bytes, and with a long path."""

import random

import pytest

from braidframe.sources import gfa, gfa_ranges
from braidframe.sources.gfa_ranges import ByteRange, RangeReader

from test_golden import GFA

MORE = "P\tring\t1+,2-,10+\t0M,3M\tXX:i:3\tTP:Z:circular\nP\tnone\t\t*\nS\t123456789\tACGTACGTACGTACGTACGTACGTACGTACGT\nL\t10\t-\t123456789\t+\t0M\nP\tlast\t123456789+,123456789-,1+,1-,2+"


def shown(g):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    return [rows(g.nodes), rows(g.edges), rows(g.paths), rows(g.steps.select("path_id", "step_rank", "node_id", "is_rev"))]


class Source:
    """A file in memory as pyarrow opens one."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def assembled(data, size, chunk=2):
    """Paths of a file by plain Python from the rows of all its ranges."""
    import pandas as pd  # noqa: F401

    names = gfa_ranges._NAMES
    records = []
    for i, lo in enumerate(range(0, len(data), size)):
        part = ByteRange("", 0, i, lo, min(lo + size, len(data)))
        records += [dict(zip(names, r)) for r in RangeReader(part, Source(data), chunk).rows()]
    line, shift, base, carry = None, 0, 0, {}
    for r in [r for r in records if r["kind"] == "R"]:
        if r["at"] is None:
            if line is not None:
                carry[r["range_no"]] = (line, shift, base)
                k = 2 - shift
                base += r["seen"][k] if 0 <= k < len(r["seen"]) else 0
                shift += r["open_tabs"]
            line = None if r["ended"] else line
        elif not r["ended"]:
            line, shift, base = r["at"], r["open_tabs"], r["seen"][2] if len(r["seen"]) > 2 else 0
    steps, circular = {}, set()
    for r in records:
        if r["kind"] not in "pC":
            continue
        at, field, first = r["at"], r["tabs"], r["first"] or 0
        if at is None:
            if r["range_no"] not in carry:
                continue
            at, s, b = carry[r["range_no"]]
            field, first = field + s, first + (b if r["tabs"] == 0 else 0)
        if r["kind"] == "C":
            circular.add(at)
        elif field == 2:
            assert len(r["ids"]) <= chunk
            steps.setdefault(at, {}).update({first + k: (n, v) for k, (n, v) in enumerate(zip(r["ids"], r["revs"]))})
    out = {}
    for r in records:
        if r["kind"] == "P":
            own = steps.get(r["at"], {})
            assert sorted(own) == list(range(len(own)))
            out[r["name"]] = ([own[k] for k in sorted(own)], r["at"] in circular)
    return out, sorted((r["name"], r["seq"]) for r in records if r["kind"] == "S"), sorted((r["a"], r["a_rev"], r["b"], r["b_rev"]) for r in records if r["kind"] == "L")


def plain(text):
    paths, s, e = {}, [], []
    for f in (x.split("\t") for x in text.split("\n")):
        if f[0] == "P":
            paths[f[1]] = ([(int(x[:-1]), x[-1] == "-") for x in f[2].split(",") if x], "TP:Z:circular" in f)
        elif f[0] == "S":
            s.append((f[1], f[2]))
        elif f[0] == "L":
            e.append((f[1], f[2] == "-", f[3], f[4] == "-"))
    return paths, sorted(s), sorted(e)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_ranges_of_every_size(monkeypatch, block):
    """Wherever the borders fall, in names, steps, tags or at line ends, the same records come out."""
    monkeypatch.setattr(gfa_ranges, "BLOCK", block)
    for text in (GFA + MORE, GFA + MORE + "\n", MORE):
        for size in [*range(1, 60), 10_000]:
            assert assembled(text.encode(), size) == plain(text), size


def test_equals_line_reader(spark, tmp_path):
    p = tmp_path / "a.gfa"
    p.write_text(GFA + MORE)
    want = shown(gfa.read_gfa(spark, str(p)))
    for size in (37, 1 << 20):
        assert shown(gfa_ranges.read_gfa_ranges(spark, str(p), size, 2)) == want
    for bad in ("S\tx\tA\n", "S\t1\tA\nS\t1\tC\n", "S\t1\tA\nL\t1\t+\t2\t+\t0M\n", "S\t1\tA\nP\tp\t1+,x+,1-\t*\n"):
        p.write_text(bad)
        with pytest.raises(gfa.GraphError):
            gfa_ranges.read_gfa_ranges(spark, str(p))


def test_round_trip_of_a_long_path(spark, tmp_path):
    """A path of many ranges, written piece by piece and read back: no row holds more than a chunk of it."""
    r = random.Random(1)
    ids = [r.randrange(1, 11) for _ in range(200_000)]
    p = tmp_path / "long.gfa"
    p.write_text(GFA + "P\tlong\t" + ",".join(f"{i}{r.choice('+-')}" for i in ids) + "\t*\tTP:Z:circular\n" + MORE)
    g = gfa_ranges.read_gfa_ranges(spark, f"file://{p}", 50_000, 1000)
    long_id = g.paths.filter("path_name = 'long' AND is_circular").first().path_id
    got = g.steps.filter(f"path_id = {long_id}").orderBy("step_rank").select("step_rank", "node_id").collect()
    assert [x.step_rank for x in got] == list(range(200_000)) and [x.node_id for x in got] == ids
    pieces = gfa_ranges.gfa_pieces(g, 1000)
    assert pieces.filter("section = 3 AND length(text) > 4000").isEmpty()
    out = str(tmp_path / "out")
    gfa_ranges.write_gfa_pieces(g, out, 1000)
    again = gfa_ranges.read_gfa_ranges(spark, out, 60_000)
    names = lambda g: {(x.path_name, x.is_circular, x.step_rank, x.node_id, x.is_rev) for x in g.paths.join(g.steps, "path_id").collect()}
    assert names(again) == names(g) and again.counts() == g.counts()
    assert sorted(tuple(x) for x in again.edges.collect()) == sorted(tuple(x) for x in g.edges.collect())
    # the files one behind the other are what the line writer writes
    import os

    text = "".join(open(f"{out}/{f}").read() for f in sorted(os.listdir(out)) if f.endswith(".gfa"))
    whole = [x.line for x in gfa.gfa_lines(g).orderBy("section", "key", "line").collect()]
    assert sorted(text.splitlines()) == sorted(whole)
