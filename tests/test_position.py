"""Positions on reference paths: known results, and plain searches on random graphs."""

import heapq
import random

import pytest

from braidframe.model import Graph, canonical
from braidframe.operators import position as P
from braidframe.sources import gfa
from test_golden import GFA

#: A graph of two paths through bubbles.
TWO = """H\tVN:Z:1.0
S\t1\tCAAATAAG
S\t2\tA
S\t3\tG
S\t4\tT
S\t5\tC
S\t6\tTTG
S\t7\tA
S\t8\tG
S\t9\tAAATTTTCTGGAGTTCTAT
P\tx\t1+,3+,5+,6+,8+,9+\t*
P\ty\t1+,2+,4+,6+,7+,9+\t*
""" + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (1, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (6, 8), (7, 9), (8, 9)))


def read(spark, tmp_path, text):
    (tmp_path / "g.gfa").write_text(text)
    g = gfa.read_gfa(spark, str(tmp_path / "g.gfa"))
    return g, {r.path_name: r.path_id for r in g.paths.collect()}


def only(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "path_id long")


def test_known_graph_positions(spark, tmp_path):
    g, ids = read(spark, tmp_path, TWO)
    d = spark.createDataFrame([(1, 6, 0, False), (2, 6, 2, False), (3, 4, 0, False)], "point long, node_id long, offset long, is_rev boolean")
    got = {r.point: (r.ref_path, r.ref_pos, r.dist, r.strand) for r in P.lifted(g, d, only(spark, ids["x"]), 40).collect()}
    assert got == {1: (ids["x"], 10, 0, "+"), 2: (ids["x"], 12, 0, "+"), 3: (ids["x"], 9, 1, "+")}
    p = P.path_points(g, spark.createDataFrame([(1, ids["y"], 10)], "point long, path_id long, pos long"))
    assert [(r.node_id, r.offset, r.is_rev) for r in p.collect()] == [(6, 0, False)]
    assert [(r.ref_pos, r.dist, r.strand) for r in P.lifted(g, p, only(spark, ids["x"]), 40, 10_000).collect()] == [(10, 0, "+")]
    assert {(r.point, r.ref_path, r.ref_pos, r.strand) for r in P.immediate(g, d, g.paths).collect()} == {(1, ids["x"], 10, "+"), (1, ids["y"], 10, "+"), (2, ids["x"], 12, "+"), (2, ids["y"], 12, "+"), (3, ids["y"], 9, "+")}


def test_known_path_positions(spark, tmp_path):
    g, ids = read(spark, tmp_path, GFA)
    asked = [("query3", 0), ("query3", 1), ("query3", 2), ("query3", 5)]
    d = spark.createDataFrame([(k, ids[n], pos) for k, (n, pos) in enumerate(asked)], "point long, path_id long, pos long")
    got = {r.point: (r.ref_pos, r.dist, r.strand) for r in P.lifted(g, P.path_points(g, d), only(spark, ids["target"]), 40, 10_000).collect()}
    assert got == {0: (0, 3, "+"), 1: (1, 3, "+"), 2: (2, 3, "+"), 3: (5, 0, "+")}
    # node 6 is visited twice: what lies next to the query is next to the first visit
    near = P.path_points(g, spark.createDataFrame([(4, ids["query1"], 5)], "point long, path_id long, pos long"))
    assert [(r.ref_pos, r.dist, r.strand) for r in P.lifted(g, near, only(spark, ids["target"]), 40, 1).collect()] == [(5, 1, "+")]
    r = spark.createDataFrame([(ids["query3"], 2, 5, "r", False), (ids["query2"], 0, 2, "lost", False)], "path_id long, start long, end long, name string, is_rev boolean")
    for each in (True,):
        out = P.lifted_ranges(g, r, only(spark, ids["target"]), 40, each=each).collect()
        assert [(x.name, x.ref_start, x.ref_end, x.strand) for x in out] == [("r", 2, 5, "+")]


def graph(spark, seed):
    r = random.Random(seed)
    n = 14
    lens = {i: r.randint(1, 4) for i in range(1, n + 1)}
    walks = {p: [(r.randint(1, n), r.random() < 0.3) for _ in range(r.randint(2, 6))] for p in range(1, 6)}
    edges = {(a, ar, b, br) for w in walks.values() for (a, ar), (b, br) in zip(w, w[1:])} | {(r.randint(1, n), r.random() < 0.5, r.randint(1, n), r.random() < 0.5) for _ in range(8)}
    nodes = spark.createDataFrame([(i, "A" * x, x, i) for i, x in lens.items()], "node_id long, seq string, len long, node_rank long")
    e = spark.createDataFrame(sorted(edges), "a long, ar boolean, b long, br boolean")
    e = e.select(canonical(e.a, e.ar, e.b, e.br).alias("e")).select("e.*").distinct()
    steps = spark.createDataFrame([(p, k, i, v) for p, w in walks.items() for k, (i, v) in enumerate(w)], "path_id long, step_rank long, node_id long, is_rev boolean")
    paths = spark.createDataFrame([(p, f"p{p}", False) for p in walks], "path_id long, path_name string, is_circular boolean")
    out = {}
    for a, ar, b, br in edges:
        out.setdefault((a, ar), set()).add((b, br))
        out.setdefault((b, not br), set()).add((a, not ar))
    return Graph(nodes, e, paths, steps), lens, walks, out


def nearest(start, goal, lens, out, radius, both):
    heap, done = [(0, 0, *start)], set()
    while heap:
        l, d, n, v = heapq.heappop(heap)
        if (n, v) in done:
            continue
        done.add((n, v))
        if n in goal:
            return l, d, n, v
        if l + lens[n] < radius:
            nxt = set(out.get((n, v), ()))
            if both:
                nxt |= {(x, not y) for x, y in out.get((n, not v), ())}
            for x in nxt:
                heapq.heappush(heap, (l + lens[n], d + 1, *x))
    return None


@pytest.mark.parametrize("seed,radius", [(1, 7), (2, 100)])
def test_searches_equal_plain_ones(spark, seed, radius):
    g, lens, walks, out = graph(spark, seed)
    goal = {n for n, _ in walks[1]}
    starts = [(n, v) for n in lens for v in (False, True)]
    got = {(r.start_node, r.start_rev): (tuple(r.hit), r.both_ways) for r in P.nearest_steps(g, spark.createDataFrame(starts, "start_node long, start_rev boolean"), only(spark, 1), radius).collect()}
    want = {}
    for s in starts:
        for both in (False, True):
            hit = nearest(s, goal, lens, out, radius, both)
            if hit:
                want[s] = (hit, both)
                break
    assert got == want and len({b for _, b in want.values()}) == 2


def brute_context(walk_of, lens, q, ts, walk):
    """Index in ts of the step that the rule takes, by walking step by step."""
    def sides(p, k):
        w = walk_of[p]
        return sum(lens[i] for i, _ in w[:k]), sum(lens[i] for i, _ in w[k + 1 :])

    short = min(min(*sides(*s), walk) for s in [q, *ts])
    long = min(min(max(sides(*s)), walk) for s in [q, *ts])

    def met(p, k, before, after):
        w, count, total = walk_of[p], {}, 0
        for order, limit in ((range(k - 1, -1, -1), before), (range(k + 1, len(w)), after)):
            d = 0
            for i in order:
                if d >= limit:
                    break
                count[w[i][0]] = count.get(w[i][0], 0) + 1
                d += lens[w[i][0]]
            total += d
        count[w[k][0]] = count.get(w[k][0], 0) + 1
        return count if total >= before + after else {}

    def like(a, b):
        if not a or not b:
            return 0.0
        i = sum(min(a.get(n, 0), b.get(n, 0)) * lens[n] for n in {*a, *b})
        return i / sum(max(a.get(n, 0), b.get(n, 0)) * lens[n] for n in {*a, *b})

    scores = [max(like(met(*q, *x), met(*t, *y)) for x in ((short, long), (long, short)) for y in ((short, long), (long, short))) for t in ts]
    best = [i for i, s in enumerate(scores) if s == max(scores)]
    return best[len(best) // 2]


@pytest.mark.parametrize("walk", [3, 12, 10_000])
def test_context_chooses_as_walking_does(spark, walk):
    r = random.Random(walk)
    lens = {i: r.randint(1, 5) for i in range(1, 7)}
    walks = {p: [(r.randint(1, 6), False) for _ in range(r.randint(3, 14))] for p in range(1, 9)}
    nodes = spark.createDataFrame([(i, "A" * x, x, i) for i, x in lens.items()], "node_id long, seq string, len long, node_rank long")
    steps = spark.createDataFrame([(p, k, i, v) for p, w in walks.items() for k, (i, v) in enumerate(w)], "path_id long, step_rank long, node_id long, is_rev boolean")
    g = Graph(nodes, nodes.limit(0), spark.createDataFrame([(p, f"p{p}", False) for p in walks], "path_id long, path_name string, is_circular boolean"), steps)
    pairs, want = [], {}
    for point, (p, k) in enumerate((p, k) for p in (1, 2, 3) for k in range(len(walks[p]))):
        t = r.choice([4, 5, 6, 7, 8])
        ts = [(t, i) for i, (n, _) in enumerate(walks[t]) if n == walks[p][k][0]]
        if ts:
            pairs += [(point, p, k, *x) for x in ts]
            want[point] = ts[brute_context(walks, lens, (p, k), ts, walk)]
    got = {x.point: (x.t_path, x.t_rank) for x in P.by_context(g, spark.createDataFrame(pairs, "point long, q_path long, q_rank long, t_path long, t_rank long"), walk).collect()}
    assert got == want
