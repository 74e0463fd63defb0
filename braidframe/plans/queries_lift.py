"""Queries over the supply graph: lift-over, matching, layout, sampling, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import liftover as L
from ..operators import rewrite as R
from ..operators import sampling as P
from ..sources.tables import account_graph, supply_graph
from ..streaming import steps as ST
from .prelude import account, supply
from .queries_core import _points
from .queries_graph import _WCC
from .registry import query

_G = supply_graph
_REF = "path_name LIKE 'NATION_1#%'"
_ON_REF = f"path_id IN (SELECT path_id FROM paths WHERE {_REF})"


def _ref(g):
    return g.paths.filter(_REF).select("path_id")


_NEAR = f""", und AS (SELECT DISTINCT src AS a, dst AS b FROM adj WHERE src <> dst), onref AS (SELECT DISTINCT node_id FROM steps WHERE {_ON_REF}),
nr(node_id, dist, ref, outp) USING KEY (node_id) AS (SELECT node_id, 0::BIGINT, node_id, 0::BIGINT FROM onref UNION
SELECT y.b, y.m.d, y.m.r, y.m.d + n.len FROM (SELECT und.b, min({{'d': nr.outp, 'r': nr.ref}}) AS m FROM nr JOIN und ON und.a = nr.node_id WHERE nr.outp <= 40 GROUP BY und.b) y JOIN nodes n ON n.node_id = y.b LEFT JOIN recurring.nr x ON x.node_id = y.b WHERE x.dist IS NULL OR (y.m.d, y.m.r) < (x.dist, x.ref)),
near AS (SELECT node_id, dist, ref AS ref_node FROM nr)"""


@query(supply(_NEAR + "SELECT node_id, dist, ref_node FROM near"))
def nearest_reference(spark, d):
    g = _G(spark, d)
    return L.nearest_reference(g, _ref(g), 40)


_FIRST = f", f AS (SELECT node_id AS ref_node, path_id, step_start, is_rev, row_number() OVER (PARTITION BY node_id ORDER BY path_id, step_start, is_rev) AS k FROM pos WHERE {_ON_REF})"


@query(supply(_NEAR + _FIRST + " SELECT node_id, dist, path_id AS ref_path, step_start AS ref_pos, CASE WHEN is_rev THEN '-' ELSE '+' END AS strand FROM near JOIN f USING (ref_node) WHERE k = 1"))
def graph_to_reference_position(spark, d):
    g = _G(spark, d)
    return L.reference_position(g, g.nodes, _ref(g), 40)


@query(supply(_NEAR + _FIRST + " SELECT node_id, dist, path_id AS ref_path, step_start AS ref_pos, CASE WHEN is_rev THEN '-' ELSE '+' END AS strand FROM near JOIN f USING (ref_node)"))
def all_reference_positions(spark, d):
    g = _G(spark, d)
    return L.reference_position(g, g.nodes, _ref(g), 40, every=True)


@query(supply(", pts AS (SELECT path_id, (path_id * 7) % path_len AS pos FROM plen), m AS (SELECT *, greatest((len + 3) // 4, 1) AS k FROM nodes), b AS (SELECT *, coalesce(sum(k) OVER (ORDER BY node_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM m), h AS (SELECT pts.path_id, pts.pos, p.is_rev, p.len, p.node_id, CASE WHEN p.is_rev THEN p.len - 1 - (pts.pos - step_start) ELSE pts.pos - step_start END AS fo FROM pts JOIN pos p USING (path_id) WHERE step_start <= pts.pos AND pts.pos < step_end) SELECT h.path_id, h.pos, base + fo // 4 + 1 AS node_id, is_rev, CASE WHEN is_rev THEN least(fo // 4 * 4 + 4, h.len) - 1 - fo ELSE fo % 4 END AS \"offset\" FROM h JOIN b USING (node_id)"))
def lift_between_graphs(spark, d):
    """From the graph to its chopped twin, through paths of the same name."""
    g = _G(spark, d)
    return L.between_graphs(g, R.chop(g, 4), _points(g))


_CTX = f""", prs AS (SELECT DISTINCT q.path_id AS q_path, q.step_rank AS q_rank, t.path_id AS t_path, t.step_rank AS t_rank FROM steps q JOIN steps t USING (node_id) WHERE q.path_id <> t.path_id AND t.{_ON_REF}),
ends AS (SELECT q_path AS path_id, q_rank AS step_rank FROM prs UNION SELECT t_path, t_rank FROM prs),
ctx AS (SELECT e.path_id, e.step_rank, o.node_id, count(*) AS cnt, any_value(o.len) AS len FROM ends e JOIN pos s USING (path_id, step_rank) JOIN pos o ON o.path_id = s.path_id AND o.step_start < s.step_end + 20 AND o.step_end > greatest(s.step_start - 20, 0) GROUP BY ALL),
tot AS (SELECT path_id, step_rank, sum(cnt * len) AS total FROM ctx GROUP BY ALL),
com AS (SELECT q_path, q_rank, t_path, t_rank, sum(least(a.cnt, b.cnt) * a.len) AS i FROM prs JOIN ctx a ON a.path_id = q_path AND a.step_rank = q_rank JOIN ctx b ON b.path_id = t_path AND b.step_rank = t_rank AND b.node_id = a.node_id GROUP BY ALL)"""


@query(supply(_CTX + "SELECT q_path, q_rank, t_path, t_rank, i::DOUBLE / (x.total + y.total - i)::DOUBLE AS jaccard FROM com JOIN tot x ON x.path_id = q_path AND x.step_rank = q_rank JOIN tot y ON y.path_id = t_path AND y.step_rank = t_rank"))
def context_jaccard(spark, d):
    g = _G(spark, d)
    q = g.steps.select(F.col("path_id").alias("q_path"), F.col("step_rank").alias("q_rank"), "node_id")
    t = g.steps.join(_ref(g), "path_id", "left_semi").select(F.col("path_id").alias("t_path"), F.col("step_rank").alias("t_rank"), "node_id")
    return L.context_jaccard(g, q.join(t, "node_id").filter("q_path != t_path").drop("node_id"), 20)


@query(supply(_CTX + """, j AS (SELECT q_path, q_rank, t_path, t_rank, i::DOUBLE / (x.total + y.total - i)::DOUBLE AS jaccard FROM com JOIN tot x ON x.path_id = q_path AND x.step_rank = q_rank JOIN tot y ON y.path_id = t_path AND y.step_rank = t_rank),
w AS (SELECT *, min(q_rank) OVER v AS lo, max(q_rank) OVER v AS hi FROM j WINDOW v AS (PARTITION BY q_path, t_path)),
e AS (SELECT *, TRUE AS walk_from_front FROM w WHERE q_rank = lo UNION ALL SELECT *, FALSE FROM w WHERE q_rank = hi),
r AS (SELECT *, row_number() OVER (PARTITION BY q_path, t_path, walk_from_front ORDER BY jaccard DESC, t_rank) AS nth FROM e)
SELECT q_path AS query, t_path AS target, walk_from_front, a.step_start AS query_pos, b.step_start AS target_start, b.step_end AS target_end, jaccard FROM r JOIN pos a ON a.path_id = q_path AND a.step_rank = q_rank JOIN pos b ON b.path_id = t_path AND b.step_rank = t_rank WHERE nth = 1"""))
def path_tips(spark, d):
    g = _G(spark, d)
    return L.tips(g, g.paths, _ref(g), 20)


@query(supply(f"SELECT DISTINCT path_id FROM steps WHERE path_id NOT IN (SELECT path_id FROM steps WHERE node_id IN (SELECT node_id FROM steps WHERE {_ON_REF}))"))
def tips_not_visited(spark, d):
    g = _G(spark, d)
    return L.not_visited(g, g.paths, _ref(g))


def _segments(name: str) -> str:
    return f""", {name}k AS (SELECT *, row_number() OVER (PARTITION BY path_id, node_id ORDER BY step_rank) > 1 AS again, TRUE AS con FROM pos),
{name}c AS (SELECT *, again OR coalesce(lag(con) OVER w, con) <> con OR step_start // 40 <> coalesce(lag(step_start) OVER w, step_start) // 40 AS cut FROM {name}k WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)),
{name}s AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY path_id ORDER BY step_rank) AS seg FROM {name}c),
{name}v AS (SELECT *, row_number() OVER (PARTITION BY path_id, seg, node_id ORDER BY step_rank) AS v FROM {name}s),
{name}n AS (SELECT path_id, seg, min(step_start) AS a, max(step_end) AS b, sum(len) AS n FROM {name}s GROUP BY ALL)"""


@query(supply(_segments("q") + _segments("t") + """, cov AS (SELECT path_id, seg, sum(c * len)::DOUBLE / sum(len)::DOUBLE AS self_cov FROM (SELECT path_id, seg, node_id, count(*) AS c, any_value(len) AS len FROM qs GROUP BY ALL) GROUP BY ALL),
m AS (SELECT q.path_id AS qp, q.seg AS qg, t.path_id AS tp, t.seg AS tg, sum(q.len) AS i, sum(CASE WHEN q.is_rev <> t.is_rev THEN q.len ELSE 0 END) AS r FROM qv q JOIN tv t USING (node_id, v) GROUP BY ALL),
s AS (SELECT m.*, x.a AS query_start, x.b AS query_end, y.a AS ref_start, y.b AS ref_end, self_cov, i::DOUBLE / (x.n + y.n - i)::DOUBLE AS score FROM m JOIN qn x ON x.path_id = qp AND x.seg = qg JOIN tn y ON y.path_id = tp AND y.seg = tg JOIN cov ON cov.path_id = qp AND cov.seg = qg),
k AS (SELECT *, row_number() OVER (PARTITION BY qp, qg ORDER BY score DESC, tp, ref_start) AS nth_best FROM s WHERE score >= 0.2)
SELECT qp AS query, query_start, query_end, tp AS ref, ref_start, ref_end, score, CASE WHEN 2 * r > i THEN '-' ELSE '+' END AS inv, self_cov, nth_best FROM k WHERE nth_best <= 2"""))
def untangle(spark, d):
    g = _G(spark, d)
    return L.untangle(g, g.paths, g.paths, 40, 2, 0.2)


@query(supply(""", k AS (SELECT *, row_number() OVER (PARTITION BY path_id, node_id ORDER BY step_rank) > 1 AS again FROM pos),
c AS (SELECT path_id, step_start AS pos, again OR step_start // 10 <> coalesce(lag(step_start) OVER w, step_start) // 10 AS cut FROM k WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)),
m(path_id, pos) AS (SELECT path_id, min(pos) FROM c WHERE cut GROUP BY 1 UNION ALL SELECT c.path_id, min(c.pos) FROM m JOIN c ON c.path_id = m.path_id AND cut AND c.pos >= m.pos + 15 GROUP BY c.path_id) SELECT path_id, pos FROM m"""))
def untangle_merged_cuts(spark, d):
    g = _G(spark, d)
    s = L.segments(g, g.paths, 10).filter("cut")
    return L.merged_cuts(s.select("path_id", F.col("step_start").alias("pos")), 15)


def _layout(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select((F.col("vec_id") + 1).alias("node_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(supply(", l AS (SELECT vec_id + 1 AS node_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT p.*, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0.0) AS d FROM pos p JOIN l USING (node_id) WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)) SELECT path_id, step_start // 20 AS \"window\", round(sum(d), 6) AS layout_dist, sum(len)::BIGINT AS nuc_dist, round(sum(d) / sum(len)::DOUBLE, 6) AS ratio FROM s GROUP BY ALL"))
def tension_windows(spark, d):
    t = L.tension(_G(spark, d), _layout(spark, d), 20)
    return t.withColumn("layout_dist", F.round("layout_dist", 6)).withColumn("ratio", F.round("ratio", 6))


@query(supply(f", b AS (SELECT DISTINCT path_id, pan_start // 100 AS bin FROM steps JOIN pan USING (node_id) WHERE {_ON_REF}), n AS (SELECT path_id, count(*) AS n FROM b GROUP BY 1), p AS (SELECT a.path_id AS path_a, c.path_id AS path_b, count(*) AS i FROM b a JOIN b c USING (bin) WHERE a.path_id < c.path_id GROUP BY ALL) SELECT path_a, path_b, i::DOUBLE / (x.n + y.n - i)::DOUBLE AS jaccard FROM p JOIN n x ON x.path_id = path_a JOIN n y ON y.path_id = path_b"))
def viz_path_similarity(spark, d):
    g = _G(spark, d)
    return L.bin_jaccard(g, 100, _ref(g))


@query(supply(", n AS (SELECT split_part(path_name, '#', 1) AS grp, pan_start // 1000 AS bin, sum(len)::BIGINT AS bp, sum(CASE WHEN is_rev THEN len ELSE 0 END)::BIGINT AS inv FROM steps JOIN pan USING (node_id) JOIN paths USING (path_id) GROUP BY ALL) SELECT grp, bin, bp::DOUBLE / 1000 AS mean_depth, inv::DOUBLE / bp AS mean_inv, '#' || upper(substr(sha256(grp), 49, 2) || substr(sha256(grp), 17, 2) || substr(sha256(grp), 33, 2)) AS colour FROM n"))
def viz_merged_prefixes(spark, d):
    from ..functions.dna import colour, name_prefix

    g = _G(spark, d)
    s = g.steps.join(g.pan_positions().select("node_id", "len", "pan_start"), "node_id").join(g.paths.select("path_id", name_prefix(F.col("path_name")).alias("grp")), "path_id")
    b = s.groupBy("grp", F.floor(F.col("pan_start") / 1000).alias("bin")).agg(F.sum("len").alias("bp"), F.sum(F.when(F.col("is_rev"), F.col("len")).otherwise(0)).alias("inv"))
    return b.select("grp", "bin", (F.col("bp") / 1000).alias("mean_depth"), (F.col("inv") / F.col("bp")).alias("mean_inv"), colour(F.col("grp")).alias("colour"))


@query(supply(", sub AS (SELECT path_name AS base, path_name || ':5-25' AS path_name FROM paths), r AS (SELECT path_name AS base, start + 4 AS start, \"end\" AS \"end\", name FROM ranges JOIN paths USING (path_id)) SELECT sub.path_name, start - 5 AS start, \"end\" - 5 AS \"end\", name FROM r JOIN sub USING (base) WHERE start >= 5 AND \"end\" <= 25"))
def rebase_bed(spark, d):
    from .queries_core import _ranges

    g = _G(spark, d)
    sub = g.with_(paths=g.paths.withColumn("path_name", F.concat("path_name", F.lit(":5-25"))))
    r = _ranges(spark, d, g).join(g.paths.select("path_id", F.col("path_name").alias("base")), "path_id").select("base", (F.col("start") + 4).alias("start"), "end", "name")
    return I.contained(r, sub)


_COVER = """, fwd AS (SELECT DISTINCT src, dst FROM adj WHERE NOT src_rev AND NOT dst_rev), comp AS (SELECT component, list(node_id ORDER BY node_id) AS ids FROM wcc GROUP BY 1),
cv(component, i, k, node_id, seen, going) AS (SELECT component, 0, 0, ids[1], [ids[1]], TRUE FROM comp UNION ALL (
SELECT component, i, k + 1, nxt, list_append(seen, nxt), TRUE FROM (SELECT cv.component, cv.i, cv.k, cv.seen, f.dst AS nxt, row_number() OVER (PARTITION BY cv.component ORDER BY len(list_filter(cv.seen, lambda x: x = f.dst)), f.dst) AS r FROM cv JOIN fwd f ON f.src = cv.node_id WHERE cv.k < 5) WHERE r = 1
UNION ALL SELECT component, i + 1, 0, nxt, list_append(seen, nxt), TRUE FROM (SELECT cv.*, (SELECT arg_min(x, (len(list_filter(cv.seen, lambda y: y = x)), x)) FROM unnest(c.ids) AS u(x)) AS nxt FROM cv JOIN comp c USING (component) WHERE cv.i < 1 AND (cv.k = 5 OR cv.node_id NOT IN (SELECT src FROM fwd)))))
SELECT 'Path_' || component || '_' || i AS path_name, k::BIGINT AS step_rank, node_id FROM cv"""


@query(account(_WCC + _COVER))
def cover_paths(spark, d):
    return P.cover(account_graph(spark, d))


def _noise(k: str, node: str, rev: str) -> str:
    h = f"('0x' || substr(sha256('priv|' || walk || '|' || {k} || '|' || {node} || '|' || {rev}), 1, 12))::BIGINT"
    return f"-ln(-ln(({h} + 1)::DOUBLE / (pow(16.0::DOUBLE, 12) + 2)))"


_PRIVATE = f""", t AS (SELECT src, src_rev, dst, dst_rev, count(*) AS n FROM trans GROUP BY ALL), st AS (SELECT node_id, is_rev, count(*) AS n FROM steps WHERE step_rank = 0 GROUP BY ALL), w AS (SELECT unnest(range(100)) AS walk),
f AS (SELECT walk, node_id, is_rev, row_number() OVER (PARTITION BY walk ORDER BY ln(1 + n) / 2 + {_noise("0", "node_id", "is_rev")} DESC, node_id, is_rev) AS r FROM w, st),
p(walk, k, node_id, is_rev) AS (SELECT walk, 0::BIGINT, node_id, is_rev FROM f WHERE r = 1 UNION ALL SELECT walk, k, dst, dst_rev FROM (SELECT walk, k + 1 AS k, dst, dst_rev, row_number() OVER (PARTITION BY walk ORDER BY ln(1 + n) / 2 + {_noise("(k + 1)", "dst", "dst_rev")} DESC, dst, dst_rev) AS r FROM p JOIN t ON t.src = p.node_id AND t.src_rev = p.is_rev WHERE k < 4) WHERE r = 1)
SELECT walk, k, node_id, is_rev FROM p"""


@query(supply(_PRIVATE))
def private_haplotypes(spark, d):
    return P.private_haplotypes(_G(spark, d))


@query()
def path_guided_order(spark, d):
    return P.path_sgd(_G(spark, d))


@query(supply("SELECT node_id, row_number() OVER (ORDER BY md5('order|' || node_id)) AS new_rank FROM nodes"))
def random_order(spark, d):
    return P.random_order(_G(spark, d))


@query()
def feedback_arc_order(spark, d):
    return P.feedback_arc_order(_G(spark, d))


@query("SELECT event_type, count(*) AS depth FROM events GROUP BY 1")
def stream_depth(spark, d):
    return ST.drained(ST.stream_depth(ST.event_stream(spark, d)), "complete")


@query("SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS depth FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def stream_windowed_depth(spark, d):
    """The windows that the watermark has closed."""
    return ST.drained(ST.windowed_depth(ST.event_stream(spark, d)))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, TRUE) AS fresh FROM events), r AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_session_runs(spark, d):
    return ST.drained(ST.session_runs(ST.event_stream(spark, d)))


@query(supply(""", m(pos) AS (SELECT min(pan_start + len) FROM pan WHERE pan_start + len > 300 UNION ALL SELECT min(pan_start + len) FROM m JOIN pan ON pan_start + len > m.pos + 300 GROUP BY m.pos),
r AS (SELECT node_id, (SELECT count(*) FROM m WHERE m.pos <= pan_start + len) AS region FROM pan), s AS (SELECT node_id, region, lag(region, 1, 0) OVER (PARTITION BY path_id ORDER BY step_rank) AS before FROM steps JOIN r USING (node_id)),
c AS (SELECT node_id, count(*) AS n FROM s WHERE region <> before GROUP BY 1)
SELECT node_id, region, coalesce(n, 0) AS n_cuts FROM r LEFT JOIN c USING (node_id)"""))
def untangle_regions(spark, d):
    """Stretches of more than 300 base pairs of the sorted nodes, by an exact scan, and how often paths come to a node from another one."""
    g = _G(spark, d)
    cuts = L.region_entries(g, 300).groupBy("node_id").agg(F.count("*").alias("n_cuts"))
    return L.cut_regions(g, 300).join(cuts, "node_id", "left").fillna(0, ["n_cuts"])


_LIFT = f""", ref AS (SELECT DISTINCT node_id FROM steps WHERE {_ON_REF}), pts AS (SELECT path_id, (path_id * 7) % path_len AS pos FROM plen),
h AS (SELECT pts.path_id, pts.pos, p.node_id, p.is_rev, pts.pos - step_start AS off FROM pts JOIN pos p USING (path_id) WHERE step_start <= pts.pos AND pts.pos < step_end),
st AS (SELECT DISTINCT node_id AS s, NOT is_rev AS sr FROM h),
fw(s, sr, node, rev, l, d) AS (SELECT s, sr, s, sr, 0::BIGINT, 0::BIGINT FROM st UNION SELECT s, sr, dst, dst_rev, l + len, d + 1 FROM fw JOIN nodes n ON n.node_id = fw.node JOIN adj a ON a.src = fw.node AND a.src_rev = fw.rev WHERE fw.node NOT IN (SELECT node_id FROM ref) AND l + len < 40),
fh AS (SELECT s, sr, min({{'l': l, 'd': d, 'n': node, 'r': rev}}) AS m FROM fw WHERE node IN (SELECT node_id FROM ref) GROUP BY ALL),
ways AS (SELECT src, src_rev, dst, dst_rev FROM adj UNION SELECT src, NOT src_rev, dst, NOT dst_rev FROM adj),
bw(s, sr, node, rev, l, d) AS (SELECT s, sr, s, sr, 0::BIGINT, 0::BIGINT FROM st ANTI JOIN fh USING (s, sr) UNION SELECT s, sr, dst, dst_rev, l + len, d + 1 FROM bw JOIN nodes n ON n.node_id = bw.node JOIN ways a ON a.src = bw.node AND a.src_rev = bw.rev WHERE bw.node NOT IN (SELECT node_id FROM ref) AND l + len < 40),
hit AS (SELECT s, sr, m, FALSE AS two_way FROM fh UNION ALL SELECT s, sr, min({{'l': l, 'd': d, 'n': node, 'r': rev}}), TRUE FROM bw WHERE node IN (SELECT node_id FROM ref) GROUP BY s, sr),
f AS (SELECT node_id, path_id AS ref_path, step_start, is_rev AS t_rev, len, row_number() OVER (PARTITION BY node_id ORDER BY path_id, step_rank) AS k FROM pos WHERE {_ON_REF})
SELECT h.path_id AS point, ref_path, step_start + CASE WHEN m.d = 0 OR (two_way AND m.d = len) THEN CASE WHEN t_rev = m.r THEN len - off ELSE off END WHEN t_rev = m.r THEN 0 ELSE len END AS ref_pos, m.l AS dist, CASE WHEN t_rev = m.r THEN '-' ELSE '+' END AS strand
FROM h JOIN hit ON s = h.node_id AND sr = NOT h.is_rev JOIN f ON f.node_id = m.n AND f.k = 1"""


@query(supply(_LIFT))
def position_lift(spark, d):
    """A position on every path, lifted to one nation's paths: forward first, then both ways."""
    from ..operators import position as O

    g = _G(spark, d)
    p = O.path_points(g, _points(g).withColumn("point", F.col("path_id")))
    return O.lifted(g, p, _ref(g), 40)


_DFS = """, hd AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM adj WHERE NOT src_rev AND NOT dst_rev)),
sd AS (SELECT node_id FROM hd UNION ALL SELECT min(node_id) FROM wcc WHERE component NOT IN (SELECT component FROM wcc JOIN hd USING (node_id)) GROUP BY component),
bf(node_id, hops) USING KEY (node_id) AS (SELECT node_id, 0::BIGINT FROM sd UNION SELECT und.b, min(bf.hops + 1) FROM bf JOIN und ON und.a = bf.node_id WHERE NOT EXISTS (SELECT 1 FROM recurring.bf x WHERE x.node_id = und.b) GROUP BY und.b),
par AS (SELECT und.b AS node_id, min(und.a) AS parent FROM und JOIN bf x ON x.node_id = und.a JOIN bf y ON y.node_id = und.b WHERE x.hops + 1 = y.hops GROUP BY 1),
tr(node_id, way) AS (SELECT node_id, [node_id] FROM sd UNION ALL SELECT p.node_id, list_append(tr.way, p.node_id) FROM tr JOIN par p ON p.parent = tr.node_id)
SELECT node_id, row_number() OVER (ORDER BY way) AS new_rank FROM tr"""


@query(account(_WCC + _DFS))
def depth_first_order(spark, d):
    from ..operators import forest as T

    return T.depth_first_order(account_graph(spark, d)).select("node_id", "new_rank")
