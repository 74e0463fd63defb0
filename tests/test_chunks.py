"""Operators along paths give the same whatever the chunks are: plain Python as measure, chunks of a few steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidframe import model
from braidframe.model import Graph
from braidframe.operators import chunks as C
from braidframe.operators import intervals as I
from braidframe.operators import liftover as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=[3, 1 << 16])
def chunk(request, monkeypatch):
    monkeypatch.setattr(model, "CHUNK", request.param)
    return request.param


def graph(spark, seed=1, n=8, paths=4, longest=40):
    r = random.Random(seed)
    lens = {i: r.choice([0, 1, 2, 5]) if i < 3 else r.randint(1, 9) for i in range(1, n + 1)}
    walks = {p: [(r.randint(1, n), r.random() < 0.3) for _ in range(r.choice([1, longest, longest - 1, 2 * longest // 3]))] for p in range(1, paths + 1)}
    nodes = spark.createDataFrame([(i, "A" * x, x, i) for i, x in lens.items()], "node_id long, seq string, len long, node_rank long")
    steps = spark.createDataFrame([(p, k, i, v) for p, w in walks.items() for k, (i, v) in enumerate(w)], "path_id long, step_rank long, node_id long, is_rev boolean")
    names = spark.createDataFrame([(p, f"p{p}", False) for p in walks], "path_id long, path_name string, is_circular boolean")
    edges = spark.createDataFrame([], "from_id long, from_rev boolean, to_id long, to_rev boolean")
    return Graph(nodes, edges, names, steps), lens, walks


def starts(walk, lens):
    at, out = 0, []
    for i, _ in walk:
        out.append(at)
        at += lens[i]
    return out


def test_previous_and_prefix(spark, chunk):
    g, lens, walks = graph(spark)
    got = rows(C.with_previous(g.steps, "node_id").select("path_id", "step_rank", "previous_node_id").fillna(-1))
    assert got == sorted((p, k, w[k - 1][0] if k else -1) for p, w in walks.items() for k in range(len(w)))
    got = rows(C.prefix_sum(g.steps, F.col("node_id"), "s").select("path_id", "step_rank", "s"))
    assert got == sorted((p, k, sum(i for i, _ in w[:k])) for p, w in walks.items() for k in range(len(w)))
    some = g.steps.filter("node_id % 3 != 0")
    want = []
    for p, w in walks.items():
        want += [(p, k, i) for k, (i, _) in enumerate([x for x in w if x[0] % 3])]
    assert rows(C.renumbered(some).select("path_id", "step_rank", "node_id")) == sorted(want)


def brute_runs(walks, lens, key):
    out = []
    for p, w in walks.items():
        at = starts(w, lens)
        k = 0
        while k < len(w):
            j = k
            while j + 1 < len(w) and key(w[j + 1][0]) == key(w[k][0]):
                j += 1
            out.append((p, key(w[k][0]), at[k], at[j] + lens[w[j][0]], j - k + 1))
            k = j + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, chunk, seed):
    g, lens, walks = graph(spark, seed, n=4)
    for some in (lambda i: i % 2, lambda i: None if i == 2 else 1, lambda i: 7):
        keys = spark.createDataFrame([(i, some(i)) for i in lens], "node_id long, key int")
        got = rows(C.runs(g.positions().join(keys, "node_id"), F.col("key")).fillna(-1))
        assert got == sorted((p, -1 if k is None else k, *x) for p, k, *x in brute_runs(walks, lens, some))
    # runs of the nodes 3 and 4, and joined over gaps
    inside = [x for x in brute_runs(walks, lens, lambda i: i > 2) if x[1]]
    for gap in (0, 1, 4, 9):
        want = []
        for p, _, a, b, n in sorted(inside, key=lambda x: (x[0], x[2])):
            if gap and want and want[-1][0] == p and a - want[-1][2] < gap:
                want[-1] = (p, want[-1][1], b, want[-1][3] + n)
            else:
                want.append((p, a, b, n))
        assert rows(I.islands(g.positions(), F.col("node_id") > 2, gap)) == sorted(want)


def test_bins_of_moves(spark, chunk):
    g, lens, walks = graph(spark, 3, n=12)
    pan, at = {}, 0
    for i in sorted(lens):
        pan[i], at = at, at + lens[i]
    links, jumps = {}, {}
    for p, w in walks.items():
        w = [x for x in w if lens[x[0]]]
        ends = [(pan[i] // 5, (pan[i] + lens[i] - 1) // 5) for i, _ in w]
        turned = [e[::-1] if v else e for e, (_, v) in zip(ends, w)]
        for a, b in zip(turned, turned[1:]):
            if abs(b[0] - a[1]) > 1:
                links[p, a[1], b[0]] = links.get((p, a[1], b[0]), 0) + 1
        seq = [(0, ends[0][0] + 1)] + [(a[1] + 1, b[0] + 1) for a, b in zip(ends, ends[1:])] + [(ends[-1][1] + 1, 0)] if ends else []
        for m in seq:
            if 0 in m or abs(m[1] - m[0]) > 1:
                jumps[p, *m] = jumps.get((p, *m), 0) + 1
    assert rows(I.bin_links(g, 5)) == sorted((*k, n) for k, n in links.items())
    assert rows(I.bin_jumps(g, 5)) == sorted((*k, n) for k, n in jumps.items())
    seen = {p: {b + 1 for i, _ in w if lens[i] for b in range(pan[i] // 5, (pan[i] + lens[i] - 1) // 5 + 1)} for p, w in walks.items()}
    want = sorted((p, a, b, n) for (p, a, b), n in jumps.items() if a and b and (a > b or any(a < x < b for x in seen[p])))
    assert rows(I.bin_jumps(g, 5, drop_gaps=True)) == want


def test_segments_and_tension(spark, chunk):
    g, lens, walks = graph(spark, 4)
    contact = spark.createDataFrame([(2,), (5,), (5,)], "node_id long")
    for c in (None, contact):
        want = []
        for p, w in walks.items():
            at, seg, seen = starts(w, lens), 0, set()
            for k, (i, _) in enumerate(w):
                cut = i in seen or (k > 0 and at[k] // 6 != at[k - 1] // 6) or (c is not None and k > 0 and (i in (2, 5)) != (w[k - 1][0] in (2, 5)))
                seg += cut
                seen.add(i)
                want.append((p, k, seg, cut))
        assert rows(L.segments(g, g.paths, 6, c).select("path_id", "step_rank", "seg", "cut")) == sorted(want)
    spots = {i: (float(i), float(i * i % 7)) for i in lens if i != 4}
    layout = spark.createDataFrame([(i, *x) for i, x in spots.items()], "node_id long, x double, y double")
    want = {}
    for p, w in walks.items():
        at, last = starts(w, lens), None
        for k, (i, _) in enumerate(w):
            if i in spots:
                d = 0.0 if last is None else float(np.hypot(*(np.array(spots[i]) - np.array(spots[last]))))
                x = want.setdefault((p, at[k] // 8), [0.0, 0])
                x[0] += d
                x[1] += lens[i]
                last = i
    got = {(r.path_id, r.window): [r.layout_dist, r.nuc_dist] for r in L.tension(g, layout, 8).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def greedy(p, apart, before=None):
    out, last = [], before
    for x in sorted(set(p)):
        if last is None or x - last >= apart:
            out.append(x)
            last = x
    return out


@pytest.mark.parametrize("apart,before,span", [(1, None, 4), (5, None, 20), (5, 0, 20), (13, -4, 13), (40, 0, 50), (3, None, None)])
def test_greedy_scan(spark, apart, before, span):
    r = random.Random(apart)
    points = {p: [r.randrange(r.choice([30, 400])) for _ in range(r.choice([1, 5, 200]))] for p in range(1, 12)}
    d = spark.createDataFrame([(p, x) for p, xs in points.items() for x in xs], "path_id long, pos long").repartition(3)
    assert rows(C.greedy_scan(d, apart, before, span)) == sorted((p, x) for p, xs in points.items() for x in greedy(xs, apart, before))
    assert C.greedy_scan(d.limit(0), apart, before, span).count() == 0


def test_chunk_maps_are_small_and_right():
    r = random.Random(8)
    for _ in range(200):
        apart, base = r.randint(1, 12), r.randint(0, 50)
        p = np.unique([base + r.randrange(120) for _ in range(r.randint(1, 60))])
        upto, last = C.chunk_map(p, base, apart)
        assert len(upto) <= apart + 1
        for carried in range(base - 30, base):
            kept = [x for x in greedy(p.tolist(), apart, carried)]
            at = int(np.searchsorted(upto, carried + apart))
            assert (last[at] if at < len(last) else carried) == (kept[-1] if kept else carried)


def test_regions_cut_nodes_as_a_scan_does(spark, chunk):
    g, lens, walks = graph(spark, 5, n=14)
    for every in (4, 11):
        pos = last = region = 0
        of = {}
        for i in sorted(lens):
            pos += lens[i]
            if pos - last > every:
                last, region = pos, region + 1
            of[i] = region
        assert dict(rows(L.cut_regions(g, every))) == of
        want = set()
        for w in walks.values():
            before = 0
            for i, _ in w:
                if of[i] != before:
                    want.add(i)
                before = of[i]
        assert [x for (x,) in rows(L.region_cuts(g, every))] == sorted(want)


@pytest.mark.parametrize("closer,rounds", [(4, 1), (9, None)])
def test_gaps_are_closed_as_walking_does(spark, chunk, closer, rounds):
    from braidframe.operators import normalise as N

    def full(s):
        r = random.Random(s)
        return all([r.choice([0, 1, 2, 5]), r.choice([0, 1, 2, 5])])

    g, lens, walks = graph(spark, next(s for s in range(6, 99) if full(s)), n=16, longest=12)
    assert all(lens.values())
    keep = {1, 4, 5, 11}
    want, done = set(keep), 0
    while rounds is None or done < rounds:
        new = set()
        for w in walks.values():
            at = starts(w, lens)
            on = [k for k, (i, _) in enumerate(w) if i in want]
            for a, b in zip(on, on[1:]):
                if b - a > 1 and at[b] - (at[a] + lens[w[a][0]]) < closer:
                    new |= {i for i, _ in w[a + 1 : b]} - want
        if not new:
            break
        want |= new
        done += 1
    got = N.close_gaps(g, spark.createDataFrame([(i,) for i in keep], "node_id long"), closer, rounds)
    assert {x for (x,) in rows(got)} == want and want > keep
