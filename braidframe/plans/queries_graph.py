"""Queries over the whole supply and account graphs: filters, rewrites and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rewrite as R
from ..operators import stats as S
from ..operators import traverse as T
from ..sources.tables import account_graph, supply_graph
from .prelude import account, supply
from .queries_core import _RC, _ranges
from .registry import query

_G = supply_graph
_A = account_graph


@query(supply("SELECT from_id, from_rev, to_id, to_rev FROM edges WHERE from_id IN (SELECT node_id FROM degree WHERE degree <= 90) AND to_id IN (SELECT node_id FROM degree WHERE degree <= 90)"))
def prune_high_degree(spark, d):
    return R.prune_high_degree(_G(spark, d), 90).edges


@query(supply("SELECT path_id, (row_number() OVER (PARTITION BY path_id ORDER BY step_rank) - 1)::BIGINT AS step_rank, node_id, is_rev FROM steps WHERE node_id IN (SELECT node_id FROM depth WHERE depth BETWEEN 25 AND 35)"))
def prune_by_depth(spark, d):
    return R.prune_by_depth(_G(spark, d), 25, 35).steps


_TRAV = ", trav AS (SELECT CASE WHEN fwd THEN src ELSE dst END AS from_id, CASE WHEN fwd THEN src_rev ELSE NOT dst_rev END AS from_rev, CASE WHEN fwd THEN dst ELSE src END AS to_id, CASE WHEN fwd THEN dst_rev ELSE NOT src_rev END AS to_rev, count(*) AS n FROM ctrans GROUP BY ALL)"


@query(supply(_TRAV + "SELECT from_id, from_rev, to_id, to_rev FROM trav WHERE n BETWEEN 2 AND 3"))
def prune_edges_by_depth(spark, d):
    return R.prune_edges_by_depth(_G(spark, d), 2, 3).edges


@query(supply(_TRAV + ", o AS (SELECT *, from_id AS s, from_rev AS sr, to_id AS t, to_rev AS tr FROM trav UNION ALL SELECT *, to_id, NOT to_rev, from_id, NOT from_rev FROM trav), r AS (SELECT *, row_number() OVER (PARTITION BY s, sr ORDER BY n DESC, t, tr) AS k FROM o) SELECT DISTINCT from_id, from_rev, to_id, to_rev FROM r WHERE k <= 2"))
def prune_best_edges(spark, d):
    return R.best_edges(_G(spark, d), 2).edges


@query(account("SELECT node_id FROM degree WHERE degree_in > 0 AND degree_out > 0"))
def cut_tips(spark, d):
    return R.cut_tips(_A(spark, d)).nodes.select("node_id")


@query(account("SELECT n.node_id FROM nodes n WHERE node_id NOT IN (SELECT node_id FROM (SELECT s.node_id, count(*) AS k, max(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS m FROM steps) s GROUP BY 1) JOIN degree USING (node_id) WHERE k = 1 AND m = 1 AND degree = 0)"))
def remove_isolated(spark, d):
    return R.remove_isolated(_A(spark, d)).nodes.select("node_id")


@query(supply("SELECT p.path_id, path_name, count(s.node_id) AS n_steps FROM paths p LEFT JOIN steps s USING (path_id) WHERE path_name LIKE 'NATION_1%' GROUP BY ALL"))
def keep_paths(spark, d):
    g = _G(spark, d)
    k = R.keep_paths(g, g.paths.filter("path_name LIKE 'NATION_1%'").select(F.col("path_name").alias("name")))
    return k.paths.join(k.steps.groupBy("path_id").agg(F.count("*").alias("n")), "path_id", "left").select("path_id", "path_name", F.coalesce("n", F.lit(0)).alias("n_steps"))


@query(supply("SELECT p.path_id, path_name, count(s.node_id) AS n_steps FROM paths p JOIN steps s USING (path_id) WHERE NOT path_name LIKE 'NATION_1%' GROUP BY ALL"))
def drop_paths(spark, d):
    g = _G(spark, d)
    k = R.drop_empty_paths(R.drop_paths(g, g.paths.filter("path_name LIKE 'NATION_1%'").select(F.col("path_name").alias("name"))))
    return k.paths.join(k.steps.groupBy("path_id").agg(F.count("*").alias("n_steps")), "path_id").select("path_id", "path_name", "n_steps")


_CHOP = ", m AS (SELECT *, greatest((len + 3) // 4, 1) AS k FROM nodes), b AS (SELECT *, coalesce(sum(k) OVER (ORDER BY node_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM m)"


@query(supply(_CHOP + ", i AS (SELECT *, unnest(range(k)) AS i FROM b) SELECT base + i + 1 AS node_id, substr(seq, i * 4 + 1, 4) AS seq, length(substr(seq, i * 4 + 1, 4))::BIGINT AS len FROM i"))
def chop_nodes(spark, d):
    return R.chop(_G(spark, d), 4).nodes.select("node_id", "seq", "len")


@query(supply(_CHOP + ", i AS (SELECT s.path_id, s.step_rank, s.is_rev, b.base, b.k, unnest(range(b.k)) AS i FROM steps s JOIN b USING (node_id)) SELECT path_id, (row_number() OVER (PARTITION BY path_id ORDER BY step_rank, i) - 1)::BIGINT AS step_rank, CASE WHEN is_rev THEN base + k - i ELSE base + i + 1 END AS node_id, is_rev FROM i"))
def chop_steps(spark, d):
    return R.chop(_G(spark, d), 4).steps


@query(supply("SELECT path_id, sum(len)::BIGINT AS bp, 0::BIGINT AS missing FROM steps JOIN nodes USING (node_id) GROUP BY path_id"))
def chop_keeps_paths(spark, d):
    """Length of every path after chopping, and its steps without an edge: none."""
    c = R.chop(_G(spark, d), 5)
    gaps = S.invalid_steps(c).groupBy("path_id").agg(F.count("*").alias("m"))
    return c.path_lengths().join(gaps, "path_id", "left").select("path_id", F.col("path_len").alias("bp"), F.coalesce("m", F.lit(0)).alias("missing"))


@query(supply("SELECT node_id, regexp_replace(seq, 'N+', 'N', 'g') AS seq, length(regexp_replace(seq, 'N+', 'N', 'g'))::BIGINT AS len FROM nodes"))
def crush_n(spark, d):
    return R.crush(_G(spark, d)).nodes.select("node_id", "seq", "len")


@query(supply(", f AS (SELECT path_id, sum(CASE WHEN is_rev THEN len ELSE -len END) > 0 AS flip FROM steps JOIN nodes USING (node_id) GROUP BY 1) SELECT path_id, path_name || CASE WHEN flip THEN '_inv' ELSE '' END AS path_name, CASE WHEN flip THEN max(step_rank) OVER (PARTITION BY path_id) - step_rank ELSE step_rank END AS step_rank, node_id, is_rev <> flip AS is_rev FROM steps JOIN f USING (path_id) JOIN paths USING (path_id)"))
def flip_paths(spark, d):
    f = R.flip_paths(_G(spark, d))
    return f.steps.join(f.paths, "path_id").select("path_id", "path_name", "step_rank", "node_id", "is_rev")


@query(supply("SELECT node_id, seq, node_rank FROM nodes UNION ALL SELECT node_id + (SELECT max(node_id) FROM nodes), seq, node_rank + (SELECT max(node_rank) FROM nodes) FROM nodes"))
def squeeze_nodes(spark, d):
    g = _G(spark, d)
    return R.squeeze([g, g], True).nodes.select("node_id", "seq", "node_rank")


_KEEP = "node_id % 3 <> 0"
_SUB = f", s AS (SELECT *, step_rank - row_number() OVER (PARTITION BY path_id ORDER BY step_rank) AS run FROM pos WHERE {_KEEP}), r AS (SELECT path_id, run, min(step_start) AS a, max(step_end) AS b, count(*) AS n_steps FROM s GROUP BY ALL) SELECT CASE WHEN a = 0 AND b = path_len THEN path_name ELSE path_name || ':' || a || '-' || b END AS path_name, r.n_steps FROM r JOIN plen USING (path_id) JOIN paths USING (path_id)"


@query(supply(_SUB))
def extract_subpaths(spark, d):
    g = _G(spark, d)
    sub = R.induced(g, g.nodes.filter(_KEEP))
    return sub.paths.join(sub.steps.groupBy("path_id").agg(F.count("*").alias("n_steps")), "path_id").select("path_name", "n_steps")


@query(supply("SELECT from_id, from_rev, to_id, to_rev FROM edges WHERE from_id % 3 <> 0 AND to_id % 3 <> 0"))
def extract_edges(spark, d):
    g = _G(spark, d)
    return R.induced(g, g.nodes.filter(_KEEP)).edges


@query(supply(f", f AS (SELECT path_id, string_agg(CASE WHEN is_rev THEN {_RC} ELSE seq END, '' ORDER BY step_rank) AS s FROM steps JOIN nodes USING (node_id) GROUP BY 1) SELECT name AS path_name, substr(s, start + 1, \"end\" - start) AS sequence FROM ranges JOIN f USING (path_id)"))
def inject_paths(spark, d):
    """The sequences of the injected paths: exactly the interval's characters, as nodes are cut at its ends."""
    g = _G(spark, d)
    i = R.inject(g, _ranges(spark, d, g))
    top = g.paths.agg(F.max("path_id")).first()[0]
    return S.fasta(i.with_(paths=i.paths.filter(F.col("path_id") > top), steps=i.steps.filter(F.col("path_id") > top)))


@query(supply(", k AS (SELECT p.path_id, split_part(path_name, '#', 1) AS prefix, avg(node_id) AS k FROM paths p LEFT JOIN steps USING (path_id) GROUP BY ALL), g AS (SELECT *, min(path_id) OVER (PARTITION BY prefix) AS g FROM k) SELECT path_id, row_number() OVER (ORDER BY g, k ASC NULLS LAST, path_id) AS new_rank FROM g"))
def sort_paths_by_mean(spark, d):
    return R.sort_paths(_G(spark, d), "avg", "#")


@query(supply(", k AS (SELECT p.path_id, min(node_id) AS k FROM paths p LEFT JOIN steps USING (path_id) GROUP BY ALL) SELECT path_id, row_number() OVER (ORDER BY k DESC NULLS LAST, path_id) AS new_rank FROM k"))
def sort_paths_by_min_reversed(spark, d):
    return R.sort_paths(_G(spark, d), "min", reverse=True)


@query(account(", r AS (SELECT node_id, node_id - row_number() OVER (ORDER BY node_id) AS g FROM nodes) SELECT min(node_id) AS first_id, max(node_id) AS last_id FROM r GROUP BY g"))
def sorted_id_ranges(spark, d):
    return R.id_ranges(_A(spark, d).nodes)


_UND = ", und AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges)"
_WCC = _UND + """, wcc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM nodes UNION
SELECT u.b, min(w.component) FROM wcc w JOIN und u ON u.a = w.node_id JOIN recurring.wcc x ON x.node_id = u.b WHERE w.component < x.component GROUP BY u.b) """
_FWD = ", fwd AS (SELECT DISTINCT src, dst FROM adj WHERE NOT src_rev AND NOT dst_rev), clo(a, b) AS (SELECT src, dst FROM fwd UNION SELECT clo.a, fwd.dst FROM clo JOIN fwd ON fwd.src = clo.b), cyc AS (SELECT DISTINCT a AS node_id FROM clo WHERE a = b), behind AS (SELECT node_id FROM cyc UNION SELECT b FROM clo JOIN cyc ON cyc.node_id = clo.a)"


@query(supply(_WCC + "SELECT node_id, component FROM wcc"))
def weak_components(spark, d):
    return T.components(_G(spark, d))


@query(account(_WCC + "SELECT node_id, component FROM wcc"))
def account_components(spark, d):
    return T.components(_A(spark, d))


_METRICS = _WCC + ", n AS (SELECT component, count(*) AS nodes, sum(len)::BIGINT AS bp FROM wcc JOIN nodes USING (node_id) GROUP BY 1), p AS (SELECT component, path_id, sum(len) AS l FROM steps JOIN nodes USING (node_id) JOIN wcc USING (node_id) GROUP BY ALL), q AS (SELECT component, sum(l)::BIGINT AS path_bp, max(l)::BIGINT AS longest_path FROM p GROUP BY 1), m AS (SELECT component, nodes, bp, coalesce(path_bp, 0) AS path_bp, coalesce(longest_path, 0) AS longest_path FROM n LEFT JOIN q USING (component))"


@query(account(_METRICS + "SELECT * FROM m"))
def component_metrics(spark, d):
    return T.component_metrics(_A(spark, d))


@query(account(_METRICS + ", k AS (SELECT component, row_number() OVER (ORDER BY bp DESC, component) AS rank FROM m) SELECT node_id, component, rank FROM wcc JOIN k USING (component) WHERE rank <= 5"))
def explode_biggest(spark, d):
    return T.explode(_A(spark, d), 5)


@query(supply(_UND + ", r(node_id, hops) AS (SELECT node_id, 0::BIGINT FROM nodes WHERE node_id <= 20 UNION SELECT und.b, hops + 1 FROM r JOIN und ON und.a = r.node_id WHERE hops < 3) SELECT node_id, min(hops) AS hops FROM r GROUP BY 1"))
def context_by_steps(spark, d):
    g = _G(spark, d)
    return T.reach(g, g.nodes.filter("node_id <= 20"), 3)


@query(supply(_UND + ", r(node_id, dist, outp) AS (SELECT node_id, 0::BIGINT, 0::BIGINT FROM nodes WHERE node_id <= 20 UNION SELECT und.b, outp, outp + len FROM r JOIN und ON und.a = r.node_id AND und.a <> und.b JOIN nodes n ON n.node_id = und.b WHERE outp <= 30) SELECT node_id, min(dist) AS dist FROM r GROUP BY 1"))
def context_by_length(spark, d):
    g = _G(spark, d)
    return T.reach_by_length(g, g.nodes.filter("node_id <= 20"), 30)


_SOURCE = "SELECT src, src_rev FROM adj GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1"


@query(supply(f", s AS ({_SOURCE}), r(node_id, is_rev, dist, outp) AS (SELECT src, src_rev, 0::BIGINT, 0::BIGINT FROM s UNION SELECT a.dst, a.dst_rev, outp, outp + len FROM r JOIN adj a ON a.src = r.node_id AND a.src_rev = r.is_rev JOIN nodes n ON n.node_id = a.dst WHERE outp <= 80) SELECT node_id, is_rev, min(dist) AS dist FROM r GROUP BY ALL"))
def shortest_paths(spark, d):
    g = _G(spark, d)
    s = g.adjacency().groupBy("src", "src_rev").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "src_rev").first()
    return T.shortest_paths(g, s["src"], s["src_rev"], limit=80)


def _ends(into: str, out: str) -> str:
    return f""", good AS (SELECT DISTINCT src, dst FROM adj WHERE NOT src_rev AND NOT dst_rev AND src <> dst),
r(node_id, dist) USING KEY (node_id) AS (SELECT node_id, 0::BIGINT FROM nodes WHERE node_id NOT IN (SELECT {into} FROM good) UNION
SELECT g.{into}, min(r.dist + n.len) AS d FROM r JOIN good g ON g.{out} = r.node_id JOIN nodes n ON n.node_id = g.{out} LEFT JOIN recurring.r x ON x.node_id = g.{into} WHERE x.dist IS NULL OR r.dist + n.len < x.dist GROUP BY g.{into})
SELECT node_id, dist FROM r"""


@query(account(_ends("dst", "src")))
def distance_to_head(spark, d):
    return T.distance_to_ends(_A(spark, d))


@query(account(_ends("src", "dst")))
def distance_to_tail(spark, d):
    return T.distance_to_ends(_A(spark, d), heads=False)


@query(account(_FWD + ", r(node_id, level) AS (SELECT node_id, 0::BIGINT FROM nodes WHERE node_id NOT IN (SELECT dst FROM fwd) UNION SELECT fwd.dst, level + 1 FROM r JOIN fwd ON fwd.src = r.node_id WHERE fwd.dst NOT IN (SELECT node_id FROM behind)), l AS (SELECT node_id, max(level) AS level FROM r GROUP BY 1) SELECT n.node_id, level, row_number() OVER (ORDER BY level ASC NULLS LAST, n.node_id) AS new_rank FROM nodes n LEFT JOIN l USING (node_id)"))
def topological_order(spark, d):
    return T.topological_order(_A(spark, d))


@query(account(_WCC + _FWD + ", bad AS (SELECT node_id FROM behind UNION SELECT from_id FROM edges WHERE from_rev <> to_rev) SELECT component, count(*) AS nodes, count(bad.node_id) = 0 AS is_acyclic FROM wcc LEFT JOIN bad USING (node_id) GROUP BY component"))
def acyclic_components(spark, d):
    return T.acyclic_components(_A(spark, d))


@query(account(_FWD + "SELECT n.node_id, least(n.node_id, coalesce(min(x.b), n.node_id)) AS component FROM nodes n LEFT JOIN (SELECT p.a, p.b FROM clo p JOIN clo q ON q.a = p.b AND q.b = p.a) x ON x.a = n.node_id GROUP BY 1"))
def strong_components(spark, d):
    return T.strong_components(_A(spark, d))


@query(account(_FWD + "SELECT src, dst FROM fwd WHERE src = dst OR EXISTS (SELECT 1 FROM clo WHERE a = dst AND b = src)"))
def cycle_edges(spark, d):
    return T.cycle_edges(_A(spark, d))


@query(account(_FWD + ", r(node_id) AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM fwd) UNION ALL SELECT fwd.dst FROM r JOIN fwd ON fwd.src = r.node_id WHERE fwd.dst NOT IN (SELECT node_id FROM behind)) SELECT node_id, count(*) AS walks FROM r GROUP BY 1"))
def count_walks(spark, d):
    return T.count_walks(_A(spark, d))


#: Letters as bases, for operators that turn sequences around and back.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtacg"
_DNA = f", dna AS (SELECT node_id, translate(seq, '{_LETTERS}', '{_BASES}') AS seq FROM nodes) "
_SEQUENCES = "SELECT path_name, string_agg(CASE WHEN is_rev THEN {rc} ELSE seq END, '' ORDER BY step_rank) AS sequence FROM steps JOIN {t} USING (node_id) JOIN paths USING (path_id) GROUP BY path_id, path_name"


def _dna(g):
    return g.with_(nodes=g.nodes.withColumn("seq", F.translate("seq", _LETTERS, _BASES)))


@query(account(_SEQUENCES.format(rc=_RC, t="nodes")))
def unchop_path_sequences(spark, d):
    """Path sequences after unchopping: what they were before."""
    return S.fasta(T.unchop(_A(spark, d)))


_ONE = ", one AS (SELECT src, src_rev FROM adj GROUP BY ALL HAVING count(*) = 1), alone AS (SELECT a.* FROM adj a JOIN one o ON o.src = a.src AND o.src_rev = a.src_rev JOIN one p ON p.src = a.dst AND p.src_rev = (NOT a.dst_rev) WHERE a.src <> a.dst)"
_PERFECT = _ONE + """, thr AS (SELECT src, src_rev, dst, dst_rev, count(*) AS n FROM (SELECT src, src_rev, dst, dst_rev FROM trans UNION ALL SELECT dst, NOT dst_rev, src, NOT src_rev FROM trans) GROUP BY ALL),
perfect AS (SELECT a.* FROM alone a LEFT JOIN thr t ON t.src = a.src AND t.src_rev = a.src_rev AND t.dst = a.dst AND t.dst_rev = a.dst_rev JOIN depth x ON x.node_id = a.src JOIN depth y ON y.node_id = a.dst WHERE x.depth = y.depth AND x.depth = coalesce(t.n, 0))"""


def _runs(links: str) -> str:
    """run: the smallest node of the chain of links that every node lies in."""
    return f""", chain(node_id, run) USING KEY (node_id) AS (SELECT node_id, node_id FROM nodes UNION
SELECT l.dst, min(c.run) FROM chain c JOIN {links} l ON l.src = c.node_id JOIN recurring.chain x ON x.node_id = l.dst WHERE c.run < x.run GROUP BY l.dst),
runs AS (SELECT run, count(*) AS n_nodes, sum(len)::BIGINT AS bp FROM chain JOIN nodes USING (node_id) GROUP BY run) """


@query(account(_PERFECT + _runs("perfect") + "SELECT bp AS len, count(*) AS n FROM runs GROUP BY 1"))
def unchop_node_lengths(spark, d):
    """How many nodes of each length unchopping leaves."""
    return T.unchop(_A(spark, d)).nodes.groupBy("len").agg(F.count("*").alias("n"))


@query(account(_ONE + _runs("alone") + "SELECT run AS unitig, n_nodes, bp FROM runs"))
def unitigs(spark, d):
    return T.unitigs(_A(spark, d)).select("unitig", "n_nodes", F.length("seq").cast("long").alias("bp"))


@query(account(_WCC + """, gr(node_id, flip) USING KEY (node_id) AS (SELECT node_id, FALSE FROM wcc WHERE node_id = component UNION
SELECT a.dst, min(a.dst_rev <> (a.src_rev <> g.flip)) FROM gr g JOIN adj a ON a.src = g.node_id WHERE NOT EXISTS (SELECT 1 FROM recurring.gr x WHERE x.node_id = a.dst) GROUP BY a.dst) SELECT node_id, flip FROM gr"""))
def groom_nodes(spark, d):
    return T.groom(_A(spark, d))


@query(account(f""", o AS (SELECT node_id, FALSE AS is_rev, seq AS s FROM nodes UNION ALL SELECT node_id, TRUE, {_RC} FROM nodes),
b AS (SELECT node_id, is_rev, unnest(range(length(s)))::INTEGER AS off, s FROM o),
w(node_id, is_rev, off, kmer, at_id, at_rev) AS (SELECT node_id, is_rev, off, substr(s, off + 1, 6), node_id, is_rev FROM b
UNION ALL SELECT w.node_id, w.is_rev, w.off, substr(w.kmer || o.s, 1, 6), a.dst, a.dst_rev FROM w JOIN adj a ON a.src = w.at_id AND a.src_rev = w.at_rev JOIN o ON o.node_id = a.dst AND o.is_rev = a.dst_rev WHERE length(w.kmer) < 6)
SELECT kmer, count(*) AS n, count(DISTINCT node_id) AS nodes FROM w WHERE length(kmer) = 6 GROUP BY kmer"""))
def kmers(spark, d):
    return T.kmers(_A(spark, d), 6).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("nodes"))


@query(supply("SELECT src, src_rev, count(*) AS ways FROM adj GROUP BY ALL HAVING count(*) > 2"))
def furcations(spark, d):
    return T.furcation_edges(_G(spark, d), 2)


@query(account(""", ways AS (SELECT src, src_rev, count(*) > 1 AS fork FROM adj GROUP BY ALL),
w(src, src_rev, bp, forks) AS (SELECT src, src_rev, 0::BIGINT, 0 FROM ways UNION SELECT a.dst, a.dst_rev, w.bp + n.len, w.forks + y.fork::INTEGER FROM w JOIN adj a USING (src, src_rev) JOIN ways y USING (src, src_rev) JOIN nodes n ON n.node_id = a.dst WHERE w.bp < 8 AND w.forks <= 1),
cut AS (SELECT DISTINCT a.src, a.src_rev, a.dst, a.dst_rev FROM w JOIN adj a USING (src, src_rev) JOIN ways y USING (src, src_rev) WHERE w.bp < 8 AND w.forks <= 1 AND w.forks + y.fork::INTEGER > 1)
SELECT from_id, from_rev, to_id, to_rev FROM edges EXCEPT SELECT src, src_rev, dst, dst_rev FROM cut EXCEPT SELECT dst, NOT dst_rev, src, NOT src_rev FROM cut"""))
def prune_furcations(spark, d):
    return T.prune_furcations(_A(spark, d), 8, 1).edges


_WALK = """{r}(node_id, is_rev, dist, outp) AS (SELECT {n}::BIGINT, {rev}, 0::BIGINT, 0::BIGINT UNION SELECT a.dst, a.dst_rev, outp, outp + len FROM {r} JOIN adj a ON a.src = {r}.node_id AND a.src_rev = {r}.is_rev JOIN nodes n ON n.node_id = a.dst WHERE outp <= 18)"""


@query(supply(", " + _WALK.format(r="there", n=1, rev="FALSE") + ", " + _WALK.format(r="back", n=2, rev="TRUE") + ", x AS (SELECT node_id, is_rev, min(dist) AS d1 FROM there GROUP BY ALL), y AS (SELECT node_id, NOT is_rev AS is_rev, min(dist) AS d2 FROM back GROUP BY ALL) SELECT DISTINCT node_id FROM x JOIN y USING (node_id, is_rev) JOIN nodes USING (node_id) WHERE node_id IN (1, 2) OR d1 + len + d2 <= 18"))
def walks_between(spark, d):
    return T.between(_G(spark, d), 1, 2, 18)


@query(account(_FWD + ", bad AS (SELECT src, dst FROM fwd WHERE src = dst OR (src > dst AND EXISTS (SELECT 1 FROM clo WHERE a = dst AND b = src))) SELECT from_id, from_rev, to_id, to_rev FROM edges EXCEPT SELECT src, FALSE, dst, FALSE FROM bad EXCEPT SELECT dst, TRUE, src, TRUE FROM bad"))
def break_cycles(spark, d):
    return T.break_cycles(_A(spark, d)).edges


@query(account(_FWD + ", b AS (SELECT src, dst FROM fwd WHERE NOT (src = dst OR (src > dst AND EXISTS (SELECT 1 FROM clo WHERE a = dst AND b = src)))), r(node_id, level) AS (SELECT node_id, 0::BIGINT FROM nodes WHERE node_id NOT IN (SELECT dst FROM b) UNION SELECT b.dst, level + 1 FROM r JOIN b ON b.src = r.node_id), l AS (SELECT node_id, max(level) AS level FROM r GROUP BY 1) SELECT node_id, level, row_number() OVER (ORDER BY level, node_id) AS new_rank FROM l"))
def cycle_breaking_order(spark, d):
    return T.topological_order(T.break_cycles(_A(spark, d)))


@query(account(_FWD + ", on_cycle AS (SELECT f.src, f.dst, len FROM fwd f JOIN nodes ON node_id = dst WHERE src = dst OR EXISTS (SELECT 1 FROM clo WHERE a = dst AND b = src)), w(first, last, d) AS (SELECT src, dst, len FROM on_cycle WHERE len <= 12 UNION SELECT first, dst, d + len FROM w JOIN on_cycle ON src = last WHERE first <> last AND d + len <= 12) SELECT first AS node_id, min(d) AS bp FROM w WHERE first = last GROUP BY 1"))
def shortest_cycles(spark, d):
    return T.shortest_cycles(_A(spark, d), 12)


@query(supply("SELECT from_id, from_rev, to_id, to_rev FROM edges"))
def lace_edges(spark, d):
    g = _G(spark, d)
    return R.lace(g.with_(edges=g.edges.filter("from_id % 2 = 0"))).edges
