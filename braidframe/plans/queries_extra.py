"""Queries over whole tables: edits, strands, unrolled cycles, blocks of haplotypes, jumps between bins, stacked layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit as E
from ..operators import intervals as I
from ..operators import normalise as N
from ..operators import stats as S
from ..operators import traverse as T
from ..sources.tables import account_graph, supply_graph
from .prelude import account, supply
from .queries_core import _ON, _ranges, _reference
from .queries_graph import _FWD, _WCC
from .registry import query


@query(supply(""", s AS (SELECT path_id, step_rank AS "at", TRUE AS old, 0 AS k, node_id, is_rev FROM steps WHERE step_rank NOT IN (1, 2) UNION ALL
SELECT path_id, 1, FALSE, k, CASE k WHEN 0 THEN n_steps ELSE 3 END, k = 1 FROM plen, (SELECT unnest([0, 1]) AS k) WHERE n_steps >= 2)
SELECT path_id, (row_number() OVER (PARTITION BY path_id ORDER BY "at", old, k) - 1)::BIGINT AS step_rank, node_id::BIGINT AS node_id, is_rev FROM s"""))
def rewrite_segments(spark, d):
    """The second and third step of every path of two or more give way to two others."""
    g = supply_graph(spark, d)
    one = F.lit(1).cast("long")
    seg = g.path_lengths().filter("n_steps >= 2").select("path_id", "n_steps", one.alias("first"), F.least("n_steps", F.lit(3).cast("long")).alias("last"))
    new = seg.select("path_id", "first", F.posexplode(F.array("n_steps", F.lit(3).cast("long"))).alias("k", "node_id")).withColumn("is_rev", F.col("k") == 1)
    return E.rewrite_segments(g, seg, new).steps


@query(supply("""SELECT path_id, step_rank + 1 AS step_rank, node_id, is_rev FROM steps UNION ALL SELECT path_id, 0, 2, TRUE FROM paths
UNION ALL SELECT path_id, coalesce(n_steps, 0) + 1, 1, FALSE FROM paths LEFT JOIN plen USING (path_id)"""))
def extend_paths(spark, d):
    """Every path with a step more at either end."""
    g = supply_graph(spark, d)
    step = lambda node, rev: g.paths.select("path_id", F.lit(0).alias("k"), F.lit(node).cast("long").alias("node_id"), F.lit(rev).alias("is_rev"))
    return E.prepend_steps(E.append_steps(g, step(1, False)), step(2, True)).steps


@query(supply("""SELECT node_id + 1000 AS node_id, CASE WHEN node_id % 2 = 0 THEN 'GA' ELSE seq END AS seq, CASE WHEN node_id % 2 = 0 THEN 2 ELSE len END AS len, node_rank FROM nodes
UNION ALL SELECT r + top + 1000, 'N', 1, r + (SELECT max(node_rank) FROM nodes) FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS r FROM nation), (SELECT max(node_id) AS top FROM nodes)"""))
def edit_nodes(spark, d):
    """Other sequences on every second node, a new node for each nation, and all ids shifted."""
    g = supply_graph(spark, d)
    top = g.nodes.agg(F.max("node_id")).first()[0]
    new = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1 + top).alias("node_id"), F.lit("N").alias("seq"))
    h = E.set_sequences(g, g.nodes.filter("node_id % 2 = 0").select("node_id", F.lit("GA").alias("seq")))
    return E.shift_ids(E.add_nodes(h, new), 1000).nodes


@query(supply("SELECT from_id, from_rev, to_id, to_rev FROM edges WHERE from_id <> to_id UNION SELECT node_id, FALSE, node_id + 1, FALSE FROM nodes WHERE node_id < (SELECT max(node_id) FROM nodes)"))
def edit_edges(spark, d):
    """Without loops, and with an edge between neighbouring ids, which is given from its far end."""
    g = supply_graph(spark, d)
    top = g.nodes.agg(F.max("node_id")).first()[0]
    yes = F.lit(True)
    new = g.nodes.filter(F.col("node_id") < top).select((F.col("node_id") + 1).alias("from_id"), yes.alias("from_rev"), F.col("node_id").alias("to_id"), yes.alias("to_rev"))
    return E.add_edges(E.drop_edges(g, g.edges.filter("from_id = to_id")), new).edges


@query(supply("SELECT (SELECT max(path_id) FROM paths) + row_number() OVER (ORDER BY path_name || '-copy') AS path_id, path_name || '-copy' AS path_name, n_steps FROM paths JOIN plen USING (path_id) UNION ALL SELECT path_id, path_name, coalesce(n_steps, 0) FROM paths LEFT JOIN plen USING (path_id)"))
def extended_paths(spark, d):
    """The graph extended by one with copies of its paths under other names."""
    g = supply_graph(spark, d)
    full = g.paths.join(g.steps.select("path_id"), "path_id", "left_semi")
    h = N.extended(g, g.with_(paths=full.withColumn("path_name", F.concat("path_name", F.lit("-copy")))))
    n = h.steps.groupBy("path_id").agg(F.count("*").alias("n"))
    return h.paths.join(n, "path_id", "left").select("path_id", "path_name", F.coalesce("n", F.lit(0)).alias("n_steps"))


@query(account(""", tie AS (SELECT src * 2 + src_rev::BIGINT AS a, dst * 2 + dst_rev::BIGINT AS b FROM adj), und AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie), points AS (SELECT node_id * 2 AS k FROM nodes UNION SELECT node_id * 2 + 1 FROM nodes),
r(k, root) USING KEY (k) AS (SELECT k, k FROM points UNION SELECT u.b, min(w.root) FROM r w JOIN und u ON u.a = w.k JOIN recurring.r x ON x.k = u.b WHERE w.root < x.root GROUP BY u.b)
SELECT node_id, CASE WHEN f.root <> b.root THEN f.root > b.root END AS flip FROM nodes JOIN r f ON f.k = node_id * 2 JOIN r b ON b.k = node_id * 2 + 1"""))
def single_strand_flips(spark, d):
    return T.single_strand_flips(account_graph(spark, d))


@query(account(_WCC + f""", t AS (SELECT node_id, 2 * count(*) FILTER (WHERE is_rev) > count(*) AS flip FROM steps WHERE {_ON} GROUP BY 1), gr(node_id, flip) USING KEY (node_id) AS (SELECT * FROM (SELECT node_id, flip FROM t UNION ALL
SELECT node_id, FALSE FROM wcc WHERE node_id = component AND component NOT IN (SELECT component FROM wcc JOIN t USING (node_id))) UNION
SELECT a.dst, min(a.dst_rev <> (a.src_rev <> g.flip)) FROM gr g JOIN adj a ON a.src = g.node_id WHERE NOT EXISTS (SELECT 1 FROM recurring.gr x WHERE x.node_id = a.dst) GROUP BY a.dst) SELECT node_id, flip FROM gr"""))
def groom_targets(spark, d):
    """Grooming along the paths of one nation."""
    g = account_graph(spark, d)
    return T.groom(g, _reference(g))


_INNER = _FWD + ", e AS (SELECT src, dst, (src >= dst)::BIGINT AS back FROM fwd WHERE src = dst OR EXISTS (SELECT 1 FROM clo WHERE a = dst AND b = src)), w(old_id, layer, dist) AS (SELECT node_id, 0::BIGINT, 0::BIGINT FROM nodes UNION SELECT dst, layer + back, dist + len FROM w JOIN e ON src = old_id JOIN nodes ON node_id = old_id WHERE dist + len < 12), copies AS (SELECT old_id, layer, min(dist) AS dist FROM w GROUP BY ALL) "


@query(account(_INNER + "SELECT * FROM copies"))
def unrolled_nodes(spark, d):
    return N.unrolled(account_graph(spark, d), 12)


@query(account(_INNER + """, x AS (SELECT a.old_id AS src, a.layer AS src_layer, b.old_id AS dst, b.layer AS dst_layer FROM fwd f LEFT JOIN e ON e.src = f.src AND e.dst = f.dst JOIN copies a ON a.old_id = f.src JOIN copies b ON b.old_id = f.dst AND b.layer = CASE WHEN e.back IS NULL THEN 0 ELSE a.layer + e.back END)
SELECT * FROM x"""))
def dagify_edges(spark, d):
    """The edges of the unrolled graph by what their ends are copies of."""
    g, c = N.dagify(account_graph(spark, d), 12)
    a = c.select(F.col("node_id").alias("from_id"), F.col("old_id").alias("src"), F.col("layer").alias("src_layer"))
    b = c.select(F.col("node_id").alias("to_id"), F.col("old_id").alias("dst"), F.col("layer").alias("dst_layer"))
    # an edge of forward nodes may be kept as its mirror image
    e = g.edges.select(F.when(F.col("from_rev"), F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(F.col("from_rev"), F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"))
    return e.join(a, "from_id").join(b, "to_id").select("src", "src_layer", "dst", "dst_layer")


@query(supply(", v AS (SELECT node_id, path_id, count(*) AS visits FROM steps GROUP BY ALL HAVING count(*) >= 1), k AS (SELECT node_id FROM v GROUP BY 1 HAVING count(*) >= 20 AND count(*) <> (SELECT count(*) FROM paths)) SELECT node_id, path_id, visits FROM v WHERE node_id IN (SELECT node_id FROM k)"))
def haplotype_blocks(spark, d):
    return S.haplotype_blocks(supply_graph(spark, d), min_paths=20)


_JUMPS = """, b AS (SELECT path_id, step_rank, pan_start // 1000 + 1 AS enter, (pan_start + len - 1) // 1000 + 1 AS leave FROM steps JOIN pan USING (node_id) WHERE len > 0),
m AS (SELECT path_id, coalesce(lag(leave) OVER w, 0) AS from_bin, enter AS to_bin, lead(leave) OVER w IS NULL AS final, leave FROM b WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)),
j AS (SELECT path_id, from_bin, to_bin, count(*) AS n FROM (SELECT path_id, from_bin, to_bin FROM m WHERE from_bin = 0 OR abs(to_bin - from_bin) > 1 UNION ALL SELECT path_id, leave, 0 FROM m WHERE final) GROUP BY ALL) """


@query(supply(_JUMPS + "SELECT * FROM j"))
def bin_jumps(spark, d):
    return I.bin_jumps(supply_graph(spark, d), 1000)


@query(supply(_JUMPS + """, seen AS (SELECT DISTINCT path_id, bin FROM (SELECT path_id, unnest(range(enter, leave + 1)) AS bin FROM b))
SELECT * FROM j WHERE from_bin <> 0 AND to_bin <> 0 AND (from_bin > to_bin OR EXISTS (SELECT 1 FROM seen s WHERE s.path_id = j.path_id AND bin > from_bin AND bin < to_bin))"""))
def bin_jumps_without_gaps(spark, d):
    return I.bin_jumps(supply_graph(spark, d), 1000, drop_gaps=True)


@query(supply(""", c AS (SELECT pan_start, len, depth, unnest(range(pan_start // 1000, (pan_start + len - 1) // 1000 + 1)) AS b FROM pan JOIN depth USING (node_id) WHERE len > 0 AND depth > 0)
SELECT b + 1 AS bin, sum((least(pan_start + len, (b + 1) * 1000) - greatest(pan_start, b * 1000)) * depth)::BIGINT AS bp, sum((least(pan_start + len, (b + 1) * 1000) - greatest(pan_start, b * 1000)) * depth)::DOUBLE / 1000 AS mean_depth FROM c GROUP BY b"""))
def bin_coverage(spark, d):
    """All paths in one row, as a compressed picture shows them."""
    return I.bin_coverage(supply_graph(spark, d), 1000)


_NATIONS = [f"NATION_{i}" for i in range(25)]
_SHARES = ", ".join(f"(coalesce(sum(len) FILTER (WHERE sample = '{n}'), 0) / any_value(t) >= 0.5)::INTEGER AS \"{n}\"" for n in _NATIONS)


@query(supply(f""", hit AS (SELECT r.path_id, start, "end", name, node_id, sum(len) AS len FROM ranges r JOIN pos p ON p.path_id = r.path_id AND step_start < "end" AND step_end > start GROUP BY ALL),
t AS (SELECT path_id, start, "end", name, sum(len) AS t FROM hit GROUP BY ALL)
SELECT path_id, start, "end", name, {_SHARES} FROM hit JOIN t USING (path_id, start, "end", name) JOIN visits USING (node_id) GROUP BY path_id, start, "end", name"""))
def presence_matrix(spark, d):
    """A row for every range, a column for every nation: whether it has half of the range at least."""
    g = supply_graph(spark, d)
    return I.presence_matrix(I.presence(g, _ranges(spark, d, g)), _NATIONS, 0.5)


@query(account(_WCC + """, pts AS (SELECT component, n.node_id, n.node_id::DOUBLE AS x, (n.node_id % 100)::DOUBLE AS y FROM wcc JOIN nodes n USING (node_id)), box AS (SELECT component, min(x) AS x0, min(y) AS y0, max(y) - min(y) + 1 AS h, count(*) AS n FROM pts GROUP BY 1),
s AS (SELECT *, coalesce(sum(h) OVER (ORDER BY n DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM box) SELECT node_id, component, x - x0 AS x, y - y0 + base AS y FROM pts JOIN s USING (component)"""))
def stack_components(spark, d):
    g = account_graph(spark, d)
    return N.stacked(g, g.nodes.select("node_id", F.col("node_id").cast("double").alias("x"), (F.col("node_id") % 100).cast("double").alias("y")))
