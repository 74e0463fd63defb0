"""Queries over the supply graph: statistics, coverage, ranges, windows, similarity, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import stats as S
from ..sources.gfa import gfa_lines
from ..sources.tables import event_graph, supply_graph, supply_ranges
from .prelude import supply
from .registry import query

#: The paths of one nation stand for a reference.
REFERENCE = "path_name LIKE 'NATION_1#%'"
_ON = f"path_id IN (SELECT path_id FROM paths WHERE {REFERENCE})"
_G = supply_graph


def _reference(g):
    return g.paths.filter(REFERENCE).select("path_id")


@query(supply("SELECT * FROM (SELECT sum(len)::BIGINT AS length, count(*) AS nodes FROM nodes), (SELECT count(*) AS edges FROM edges), (SELECT count(*) AS paths FROM paths), (SELECT count(*) AS steps FROM steps)"))
def graph_summary(spark, d):
    return S.summary(_G(spark, d))


@query(supply("SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM nodes) GROUP BY base"))
def base_content(spark, d):
    return S.base_content(_G(spark, d))


@query(supply("SELECT node_id, depth, depth_uniq FROM depth"))
def node_depth_table(spark, d):
    return S.depth_table(_G(spark, d))


@query(supply(f"SELECT n.node_id, count(s.path_id)::BIGINT AS depth, count(DISTINCT s.path_id)::BIGINT AS depth_uniq FROM nodes n LEFT JOIN (SELECT * FROM steps WHERE {_ON}) s USING (node_id) GROUP BY 1"))
def node_depth_subset(spark, d):
    g = _G(spark, d)
    return S.depth_table(g, _reference(g))


@query(supply("SELECT count(*) AS node_count, sum(len)::BIGINT AS graph_length, sum(depth)::BIGINT AS step_count, sum(depth * len)::BIGINT AS path_length, sum(depth)::DOUBLE / count(*) AS mean_node_depth, sum(depth * len)::DOUBLE / sum(len)::DOUBLE AS mean_graph_depth FROM nodes JOIN depth USING (node_id)"))
def depth_summary(spark, d):
    return S.depth_summary(_G(spark, d))


@query(supply("SELECT node_id, degree, degree_in, degree_out FROM degree"))
def node_degree_table(spark, d):
    return S.degree_table(_G(spark, d))


@query(supply("SELECT count(*) AS node_count, floor(sum(degree) / 2)::BIGINT AS edge_count, sum(degree)::DOUBLE / count(*) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM degree"))
def degree_summary(spark, d):
    return S.degree_summary(_G(spark, d))


@query(supply(f"SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM steps WHERE {_ON}) THEN degree ELSE 0 END AS degree FROM degree"))
def degree_subset_paths(spark, d):
    g = _G(spark, d)
    return S.subset_degree(g, _reference(g))


@query(supply("SELECT path_id, sum(depth * len)::BIGINT AS total, sum(len)::BIGINT AS n FROM steps JOIN nodes USING (node_id) JOIN depth USING (node_id) GROUP BY path_id"))
def depth_vector_totals(spark, d):
    g = _G(spark, d)
    v = S.base_vector(g, S.depth_table(g), "depth")
    return v.select("path_id", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("v").cast("long").alias("n"))


@query(supply("SELECT path_id, step_rank, node_id, count(*) OVER (PARTITION BY path_id, node_id) AS self_depth, count(*) OVER (PARTITION BY path_id, node_id) * degree AS self_degree FROM steps JOIN degree USING (node_id)"))
def self_depth_degree(spark, d):
    return S.self_visits(_G(spark, d))


@query(supply(", k AS (SELECT node_id, count(*) AS k FROM visits GROUP BY 1), v AS (SELECT sample, CASE WHEN k = 1 THEN 'private' WHEN k = (SELECT count(DISTINCT sample) FROM visits) THEN 'core' ELSE 'shell' END AS kind, len FROM visits JOIN k USING (node_id) JOIN nodes USING (node_id)) SELECT sample, coalesce(sum(len) FILTER (WHERE kind = 'core'), 0)::BIGINT AS core, coalesce(sum(len) FILTER (WHERE kind = 'private'), 0)::BIGINT AS private, coalesce(sum(len) FILTER (WHERE kind = 'shell'), 0)::BIGINT AS shell FROM v GROUP BY sample"))
def sample_sharing(spark, d):
    return S.sharing(_G(spark, d))


@query(supply("SELECT count(*) AS total, count(DISTINCT from_id) AS unique_nodes FROM edges WHERE from_id = to_id"))
def self_loops(spark, d):
    return S.self_loops(_G(spark, d))


_RC = "translate(reverse(seq), 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbnEFIJLOPQXZefijlopqxz', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvnNNNNNNNNNNnnnnnnnnnn')"


@query(supply(f", o AS (SELECT a.*, substr(CASE WHEN dst_rev THEN {_RC} ELSE seq END, 1, 1) AS first_base FROM adj a JOIN nodes n ON n.node_id = a.dst), c AS (SELECT *, count(*) OVER (PARTITION BY src, src_rev, first_base) AS n FROM o) SELECT src, src_rev, dst, dst_rev, first_base FROM c WHERE n > 1"))
def nondeterministic_edges(spark, d):
    return S.nondeterministic_edges(_G(spark, d))


@query(supply("SELECT path_id, step_rank, src, src_rev, dst, dst_rev FROM trans t WHERE NOT EXISTS (SELECT 1 FROM adj a WHERE a.src = t.src AND a.src_rev = t.src_rev AND a.dst = t.dst AND a.dst_rev = t.dst_rev AND a.src % 7 <> 0 AND a.dst % 7 <> 0)"))
def validate_steps(spark, d):
    g = _G(spark, d)
    return S.invalid_steps(g.with_(edges=g.edges.filter("from_id % 7 <> 0 AND to_id % 7 <> 0")))


@query(supply("SELECT path_id, node_id, count(*) * len AS visits FROM steps JOIN nodes USING (node_id) GROUP BY path_id, node_id, len"))
def haplotype_matrix(spark, d):
    return S.haplotype_matrix(_G(spark, d), scaled=True)


@query(supply("SELECT node_id, len, CASE WHEN k < 1 THEN 'c<1' WHEN k < 3 THEN '1<=c<3' ELSE 'c>=3' END AS class FROM (SELECT n.node_id, n.len, count(v.sample) AS k FROM nodes n LEFT JOIN visits v USING (node_id) GROUP BY ALL)"))
def coverage_levels(spark, d):
    return S.coverage_classes(_G(spark, d))


@query(supply("SELECT node_id, len, CASE WHEN k < 0.25 THEN 'c<0.25' WHEN k < 0.75 THEN '0.25<=c<0.75' ELSE 'c>=0.75' END AS class FROM (SELECT n.node_id, n.len, count(v.sample)::DOUBLE / (SELECT count(DISTINCT sample) FROM visits) AS k FROM nodes n LEFT JOIN visits v USING (node_id) GROUP BY ALL)"))
def fraction_levels(spark, d):
    return S.coverage_classes(_G(spark, d), (0.25, 0.75), fraction=True)


@query(supply(f"SELECT n.node_id, len, (length(seq) - length(replace(replace(seq, 'N', ''), 'n', '')))::BIGINT AS uncalled, coalesce(string_agg(DISTINCT path_name, ',' ORDER BY path_name), '') AS paths FROM nodes n LEFT JOIN (steps JOIN paths USING (path_id)) s USING (node_id) WHERE n.node_id NOT IN (SELECT node_id FROM steps WHERE {_ON}) GROUP BY ALL"))
def non_reference_nodes(spark, d):
    g = _G(spark, d)
    return S.non_reference_nodes(g, _reference(g))


@query(supply(", c AS (SELECT CASE WHEN fwd THEN src ELSE dst END AS from_id, CASE WHEN fwd THEN src_rev ELSE NOT dst_rev END AS from_rev, CASE WHEN fwd THEN dst ELSE src END AS to_id, CASE WHEN fwd THEN dst_rev ELSE NOT src_rev END AS to_rev, count(*)::DOUBLE AS weight FROM ctrans GROUP BY ALL) SELECT from_id AS src, to_id AS dst, weight FROM c UNION ALL SELECT to_id, from_id, weight FROM c"))
def matrix_visits(spark, d):
    return S.matrix(_G(spark, d), "visits")


@query(supply(", c AS (SELECT from_id, to_id, CASE WHEN from_id = to_id THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / abs(from_id - to_id) END AS weight FROM edges) SELECT from_id AS src, to_id AS dst, weight FROM c UNION ALL SELECT to_id, from_id, weight FROM c"))
def matrix_delta(spark, d):
    return S.matrix(_G(spark, d), "delta")


_LINKS = ", l AS (SELECT t.*, a.node_rank AS ra, b.node_rank AS rb, abs((CASE WHEN dst_rev THEN b.pan_start + b.len ELSE b.pan_start END) - (CASE WHEN src_rev THEN a.pan_start ELSE a.pan_start + a.len END)) AS nt, abs(b.node_rank - a.node_rank) AS node_gap FROM trans t JOIN pan a ON a.node_id = src JOIN pan b ON b.node_id = dst)"


@query(supply(_LINKS + ", p AS (SELECT path_name AS path, sum(node_gap) AS a, sum(nt) AS b, count(*) AS n FROM l JOIN paths USING (path_id) GROUP BY path_name) SELECT path, a::DOUBLE / n AS in_node_space, b::DOUBLE / n AS in_nucleotide_space, n::BIGINT AS num_links FROM (SELECT * FROM p UNION ALL SELECT 'all_paths', sum(a), sum(b), sum(n) FROM p)"))
def mean_links_length(spark, d):
    return S.mean_links_length(_G(spark, d))


@query(supply(_LINKS + "SELECT path_id, sum(node_gap * ((CASE WHEN rb < ra THEN 3 ELSE 1 END) + (CASE WHEN src_rev <> dst_rev THEN 2 ELSE 0 END)))::BIGINT AS distance, count(*) AS num_links FROM l GROUP BY path_id"))
def sum_path_distances(spark, d):
    return S.sum_path_distances(_G(spark, d))


@query(supply(_LINKS + "SELECT count(*) FILTER (WHERE src_rev = dst_rev AND CASE WHEN src_rev THEN rb >= ra ELSE rb <= ra END) AS feedback_arcs, count(*) FILTER (WHERE src_rev <> dst_rev) AS reversing_joins FROM l"))
def feedback_and_reversals(spark, d):
    return S.feedback_and_reversals(_G(spark, d))


@query(supply(_LINKS + "SELECT sum(CASE WHEN NOT src_rev AND NOT dst_rev AND rb > ra THEN 0 ELSE nt END)::BIGINT AS gaps, sum(CASE WHEN NOT src_rev AND NOT dst_rev AND rb > ra THEN 0 ELSE nt END)::DOUBLE / (SELECT sum(path_len) FROM plen)::DOUBLE AS links_per_nt FROM l"))
def links_per_nucleotide(spark, d):
    return S.links_per_nucleotide(_G(spark, d))


@query(supply("SELECT path_id, step_rank, node_id, row_number() OVER w AS k, lag(step_rank) OVER w AS prev_visit, lead(step_rank) OVER w AS next_visit FROM steps WINDOW w AS (PARTITION BY path_id, node_id ORDER BY step_rank)"))
def kth_occurrence(spark, d):
    return S.kth_occurrence(_G(spark, d))


@query(supply("SELECT path_name, 1::BIGINT AS start, coalesce(path_len, 0)::BIGINT AS length FROM paths LEFT JOIN plen USING (path_id)"))
def path_list(spark, d):
    return S.path_list(_G(spark, d))


@query(supply("SELECT 'graph' AS name, pan_start AS start, pan_start + len AS \"end\", path_name, CASE WHEN is_rev THEN '-' ELSE '+' END AS strand, step_rank FROM steps JOIN pan USING (node_id) JOIN paths USING (path_id)"))
def flatten_steps(spark, d):
    return S.flatten(_G(spark, d), "graph")


@query(supply(f"SELECT path_name, string_agg(CASE WHEN is_rev THEN {_RC} ELSE seq END, '' ORDER BY step_rank) AS sequence FROM steps JOIN nodes USING (node_id) JOIN paths USING (path_id) GROUP BY path_id, path_name"))
def path_fasta(spark, d):
    return S.fasta(_G(spark, d))


@query(supply(", grp AS (SELECT DISTINCT split_part(path_name, '#', 1) AS sample FROM paths), p AS (SELECT permutation, sample, row_number() OVER (PARTITION BY permutation ORDER BY md5('heaps|' || permutation || '|' || sample), sample) AS nth_genome FROM grp, (SELECT unnest(range(3)) AS permutation)), f AS (SELECT permutation, node_id, min(nth_genome) AS nth_genome FROM visits JOIN p USING (sample) GROUP BY ALL), b AS (SELECT permutation, nth_genome, sum(len) AS bp FROM f JOIN nodes USING (node_id) GROUP BY ALL) SELECT p.permutation, p.nth_genome, (sum(coalesce(bp, 0)) OVER (PARTITION BY p.permutation ORDER BY p.nth_genome))::BIGINT AS base_pairs FROM p LEFT JOIN b USING (permutation, nth_genome)"))
def heaps_curve(spark, d):
    return S.heaps(_G(spark, d))


@query(supply("SELECT path_id, step_rank, node_id, lag(node_id) OVER w AS prev_node, lead(node_id) OVER w AS next_node FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)"))
def step_navigation(spark, d):
    return S.step_navigation(_G(spark, d))


@query(supply("SELECT path_id, step_rank, node_id, is_rev, step_start, step_end FROM pos"))
def step_index(spark, d):
    return _G(spark, d).positions().select("path_id", "step_rank", "node_id", "is_rev", "step_start", "step_end")


@query(supply("SELECT node_id, pan_start FROM pan"))
def graph_coordinate_index(spark, d):
    return _G(spark, d).pan_positions().select("node_id", "pan_start")


@query(supply("SELECT from_id, from_rev, to_id, to_rev FROM edges"))
def canonical_edges(spark, d):
    return _G(spark, d).edges


@query(supply("SELECT src, src_rev, dst, dst_rev FROM adj"))
def follow_edges(spark, d):
    return _G(spark, d).adjacency()


_MEAN = "SELECT r.path_id, start, \"end\", name, sum({v} * (least(\"end\", step_end) - greatest(start, step_start)))::DOUBLE / (\"end\" - start) AS mean FROM ranges r JOIN pos p ON p.path_id = r.path_id AND step_start < \"end\" AND step_end > start JOIN {t} USING (node_id) GROUP BY r.path_id, start, \"end\", name"


def _ranges(spark, d, g):
    return I.clipped(supply_ranges(spark, d), g)


@query(supply(_MEAN.format(v="depth", t="depth")))
def depth_over_ranges(spark, d):
    g = _G(spark, d)
    return I.mean_over_ranges(g, _ranges(spark, d, g), S.depth_table(g), "depth")


@query(supply(_MEAN.format(v="degree", t="degree")))
def degree_over_ranges(spark, d):
    g = _G(spark, d)
    return I.mean_over_ranges(g, _ranges(spark, d, g), S.degree_table(g), "degree")


@query(supply("SELECT path_id, 0::BIGINT AS start, sum(len)::BIGINT AS \"end\", sum(degree * len)::DOUBLE / sum(len)::DOUBLE AS mean FROM steps JOIN nodes USING (node_id) JOIN degree USING (node_id) GROUP BY path_id"))
def degree_over_paths(spark, d):
    g = _G(spark, d)
    return I.mean_over_paths(g, S.degree_table(g), "degree")


def _islands(inside: str, table: str, merge: int, tail: str) -> str:
    return supply(f""", a AS (SELECT path_id, step_rank, step_start, step_end, {inside} AS ins FROM pos {table}),
b AS (SELECT *, CASE WHEN ins AND NOT coalesce(lag(ins) OVER (PARTITION BY path_id ORDER BY step_rank), FALSE) THEN 1 ELSE 0 END AS fresh FROM a),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY step_rank) AS run FROM b),
e AS (SELECT path_id, run, min(step_start) AS start, max(step_end) AS "end", count(*) AS n_steps FROM c WHERE ins GROUP BY ALL),
f AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY path_id ORDER BY start) >= {merge}, TRUE) THEN 1 ELSE 0 END AS far FROM e),
h AS (SELECT *, sum(far) OVER (PARTITION BY path_id ORDER BY start) AS grp FROM f),
runs AS (SELECT path_id, min(start) AS start, max("end") AS "end", sum(n_steps)::BIGINT AS n_steps FROM h GROUP BY path_id, grp) {tail}""")


@query(_islands("depth BETWEEN 20 AND 32", "JOIN depth USING (node_id)", 12, "SELECT path_id, start, \"end\" FROM runs"))
def depth_windows_in(spark, d):
    g = _G(spark, d)
    return I.windows(g, S.depth_table(g), "depth", 20, 32, merge=12)


@query(_islands("NOT (depth_uniq BETWEEN 20 AND 32)", "JOIN depth USING (node_id)", 0, "SELECT path_id, start, \"end\" FROM runs JOIN plen USING (path_id) WHERE start = 0 OR \"end\" = path_len"))
def depth_windows_out_tips(spark, d):
    g = _G(spark, d)
    return I.windows(g, S.depth_table(g), "depth_uniq", 20, 32, out=True, only_tips=True)


@query(_islands("degree BETWEEN 40 AND 60", "JOIN degree USING (node_id)", 0, "SELECT path_id, start, \"end\" FROM runs"))
def degree_windows_in(spark, d):
    g = _G(spark, d)
    return I.windows(g, S.degree_table(g), "degree", 40, 60)


@query(_islands(f"node_id NOT IN (SELECT node_id FROM steps WHERE {_ON})", "", 0, "SELECT path_id, start, \"end\", n_steps FROM runs WHERE \"end\" - start >= 10"))
def non_reference_ranges(spark, d):
    g = _G(spark, d)
    return I.non_reference_ranges(g, _reference(g), 10)


@query(supply(""", k AS (SELECT n.node_id, CASE WHEN count(v.sample) < 12 THEN 'c<12' WHEN count(v.sample) < 18 THEN '12<=c<18' ELSE 'c>=18' END AS class FROM nodes n LEFT JOIN visits v USING (node_id) GROUP BY 1),
a AS (SELECT pos.*, class, CASE WHEN coalesce(lag(class) OVER (PARTITION BY path_id ORDER BY step_rank) = class, FALSE) THEN 0 ELSE 1 END AS fresh FROM pos JOIN k USING (node_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY step_rank) AS run FROM a) SELECT path_id, min(step_start) AS start, max(step_end) AS "end", class FROM b GROUP BY path_id, run, class"""))
def path_range_class(spark, d):
    return I.class_ranges(_G(spark, d), (12, 18))


_PAV = ", hit AS (SELECT r.path_id, r.start, r.\"end\", r.name, p.node_id, p.len FROM ranges r JOIN pos p ON p.path_id = r.path_id AND step_start < \"end\" AND step_end > start)"


@query(supply(_PAV + ", t AS (SELECT path_id, start, \"end\", name, sum(len) AS t FROM hit GROUP BY ALL), c AS (SELECT path_id, start, \"end\", name, sample AS grp, sum(len) AS c FROM hit JOIN visits USING (node_id) GROUP BY ALL) SELECT c.path_id, c.start, c.\"end\", c.name, grp, c::DOUBLE / t::DOUBLE AS pav FROM c JOIN t USING (path_id, start, \"end\", name)"))
def presence_absence(spark, d):
    g = _G(spark, d)
    return I.presence(g, _ranges(spark, d, g))


@query(supply(", hit AS (SELECT DISTINCT r.path_id, start, \"end\", node_id, is_rev FROM ranges r JOIN pos p ON p.path_id = r.path_id AND step_start < \"end\" AND step_end >= start) SELECT DISTINCT h.path_id, start, \"end\", s.path_id AS touched FROM hit h JOIN steps s USING (node_id, is_rev) WHERE s.path_id <> h.path_id"))
def overlap_paths(spark, d):
    g = _G(spark, d)
    return I.touching_paths(g, _ranges(spark, d, g))


_POINTS = ", pts AS (SELECT path_id, (path_id * 7) % path_len AS pos FROM plen)"


def _points(g):
    return g.path_lengths().select("path_id", ((F.col("path_id") * 7) % F.col("path_len")).alias("pos"))


@query(supply(_POINTS + "SELECT path_id, pos.step_rank, pts.pos, node_id, is_rev, len, pts.pos - step_start AS \"offset\" FROM pts JOIN pos USING (path_id) WHERE step_start <= pts.pos AND pts.pos < step_end"))
def path_to_graph_position(spark, d):
    g = _G(spark, d)
    return I.steps_at(g, _points(g))


@query(supply(_POINTS + "SELECT path_id, pts.pos + 1 AS pos, pan_start + CASE WHEN is_rev THEN pos.len - 1 - (pts.pos - step_start) ELSE pts.pos - step_start END + 1 AS pan_pos FROM pts JOIN pos USING (path_id) JOIN pan USING (node_id) WHERE step_start <= pts.pos AND pts.pos < step_end"))
def graph_coordinate(spark, d):
    g = _G(spark, d)
    return I.graph_coordinates(g, _points(g).withColumn("pos", F.col("pos") + 1))


@query(supply(", a AS (SELECT path_id, start, \"end\" FROM ranges UNION ALL SELECT path_id, path_len, path_len FROM plen), b AS (SELECT *, coalesce(max(\"end\") OVER (PARTITION BY path_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM a) SELECT path_id, f::BIGINT AS start, start::BIGINT AS \"end\" FROM b WHERE f < start"))
def inverse_ranges(spark, d):
    g = _G(spark, d)
    return I.complement(_ranges(spark, d, g), g)


_SIM = ", v AS (SELECT node_id, sample, cnt * len AS bp FROM visits JOIN nodes USING (node_id)), t AS (SELECT sample, sum(bp) AS n FROM v GROUP BY 1), p AS (SELECT a.sample AS group_a, b.sample AS group_b, sum(least(a.bp, b.bp)) AS i FROM v a JOIN v b USING (node_id) GROUP BY ALL), q AS (SELECT group_a, group_b, x.n::BIGINT AS group_a_length, y.n::BIGINT AS group_b_length, i::BIGINT AS intersection, i::DOUBLE / (x.n + y.n - i)::DOUBLE AS jaccard, i::DOUBLE / sqrt((x.n * y.n)::DOUBLE) AS cosine, 2.0::DOUBLE * i::DOUBLE / (x.n + y.n)::DOUBLE AS dice FROM p JOIN t x ON x.sample = group_a JOIN t y ON y.sample = group_b)"


@query(supply(_SIM + "SELECT *, 2.0::DOUBLE * jaccard / (1.0::DOUBLE + jaccard) AS estimated_identity FROM q"))
def similarity(spark, d):
    return I.similarity(_G(spark, d))


@query(supply(_SIM + "SELECT group_a, group_b, group_a_length, group_b_length, intersection, 1 - jaccard AS jaccard_distance, 1 - cosine AS cosine_distance, 1 - dice AS dice_distance, 1 - 2.0::DOUBLE * jaccard / (1.0::DOUBLE + jaccard) AS estimated_difference, (group_a_length + group_b_length - 2 * intersection)::DOUBLE AS manhattan_distance FROM q"))
def similarity_distances(spark, d):
    return I.similarity(_G(spark, d), distances=True)


@query(supply(", v AS (SELECT split_part(path_name, '#', 2) AS grp, path_id, node_id, is_rev, count(*) AS c, any_value(len) AS len FROM steps JOIN paths USING (path_id) JOIN nodes USING (node_id) GROUP BY ALL), p AS (SELECT a.grp, a.path_id AS query, b.path_id AS target, sum(least(a.c, b.c) * a.len) AS overlap FROM v a JOIN v b USING (grp, node_id, is_rev) WHERE a.path_id <> b.path_id GROUP BY ALL) SELECT (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = grp::BIGINT) || '#' || grp AS grp, query, target, overlap::BIGINT AS overlap, overlap::DOUBLE / ((x.path_len + y.path_len)::DOUBLE / 2.0::DOUBLE) AS overlap_frac FROM p JOIN plen x ON x.path_id = query JOIN plen y ON y.path_id = target"))
def path_overlap_in_group(spark, d):
    return I.oriented_overlap(_G(spark, d), fields=2)


_BINS = """, x AS (SELECT p.*, pan_start, unnest(range(pan_start // 1000, (pan_start + p.len - 1) // 1000 + 1)) AS bin FROM pos p JOIN pan USING (node_id) WHERE p.len > 0),
y AS (SELECT *, greatest(pan_start, bin * 1000) AS lo, least(pan_start + len, (bin + 1) * 1000) AS hi FROM x),
z AS (SELECT path_id, bin, hi - lo AS m, CASE WHEN is_rev THEN hi - lo ELSE 0 END AS inv, step_start + CASE WHEN is_rev THEN pan_start + len - hi ELSE lo - pan_start END AS w, lo - bin * 1000 AS lo, hi - bin * 1000 AS hi FROM y)
SELECT path_id, bin, sum(m)::BIGINT AS bp, sum(m)::DOUBLE / 1000 AS mean_cov, sum(inv)::DOUBLE / sum(m)::DOUBLE AS mean_inv, sum(m * w + (m * (m - 1)) // 2)::DOUBLE / sum(m)::DOUBLE / path_len AS mean_pos, min(lo) AS first_nucl, max(hi) - 1 AS last_nucl FROM z JOIN plen USING (path_id) GROUP BY path_id, bin, path_len"""


@query(supply(_BINS))
def bin_table(spark, d):
    return I.bins(_G(spark, d), 1000)


@query(supply(", e AS (SELECT path_id, step_rank, (CASE WHEN is_rev THEN pan_start + len - 1 ELSE pan_start END) // 1000 AS enter, (CASE WHEN is_rev THEN pan_start ELSE pan_start + len - 1 END) // 1000 AS leave FROM steps JOIN pan USING (node_id) WHERE len > 0), f AS (SELECT *, lag(leave) OVER (PARTITION BY path_id ORDER BY step_rank) AS from_bin FROM e) SELECT path_id, from_bin, enter AS to_bin, count(*) AS n FROM f WHERE abs(enter - from_bin) > 1 GROUP BY ALL"))
def bin_links(spark, d):
    return I.bin_links(_G(spark, d), 1000)


@query(supply("SELECT a.path_id, a.step_start AS from_pos, b.step_start AS to_pos FROM pos a JOIN pos b ON a.path_id = b.path_id AND a.node_id = b.node_id AND a.step_rank < b.step_rank"))
def self_dotplot(spark, d):
    return I.self_dotplot(_G(spark, d))


@query(supply(_PAV + ", a AS (SELECT node_id, string_agg(DISTINCT name, ';' ORDER BY name) AS annotation FROM hit GROUP BY 1) SELECT node_id, annotation, '#' || upper(substr(sha256(annotation), 49, 2) || substr(sha256(annotation), 17, 2) || substr(sha256(annotation), 33, 2)) AS colour FROM a"))
def annotate_nodes(spark, d):
    g = _G(spark, d)
    return I.annotations(g, _ranges(spark, d, g))


@query(supply("""SELECT 0 AS section, 0::BIGINT AS key, 'H' || chr(9) || 'VN:Z:1.0' AS line
UNION ALL SELECT 1, node_rank, 'S' || chr(9) || node_id || chr(9) || seq || chr(9) || 'DP:i:' || depth || chr(9) || 'RC:i:' || depth * len FROM nodes JOIN depth USING (node_id)
UNION ALL SELECT 2, from_id, 'L' || chr(9) || from_id || chr(9) || CASE WHEN from_rev THEN '-' ELSE '+' END || chr(9) || to_id || chr(9) || CASE WHEN to_rev THEN '-' ELSE '+' END || chr(9) || '0M' FROM edges
UNION ALL SELECT 3, p.path_id, 'P' || chr(9) || path_name || chr(9) || coalesce(string_agg(node_id || CASE WHEN is_rev THEN '-' ELSE '+' END, ',' ORDER BY step_rank), '') || chr(9) || '*' FROM paths p LEFT JOIN steps s USING (path_id) GROUP BY p.path_id, path_name"""))
def view_gfa(spark, d):
    return gfa_lines(_G(spark, d), annotated=True)


_EVENTS = "WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS node_id FROM (SELECT DISTINCT event_type FROM events)), steps AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step_rank, node_id, length(event_type) AS len FROM events JOIN kinds USING (event_type)) "


@query(_EVENTS + "SELECT node_id, count(*)::BIGINT AS depth, count(DISTINCT path_id)::BIGINT AS depth_uniq FROM steps GROUP BY 1")
def event_depth(spark, d):
    return S.depth_table(event_graph(spark, d))


@query(_EVENTS + ", r AS (SELECT *, coalesce(lag(node_id) OVER (PARTITION BY path_id ORDER BY step_rank) = node_id, FALSE) AS same FROM steps) SELECT count(*) AS runs FROM r WHERE NOT same")
def event_runs(spark, d):
    from ..model import step_order

    s = event_graph(spark, d).steps
    r = s.withColumn("same", F.coalesce(F.lag("node_id").over(step_order()) == F.col("node_id"), F.lit(False)))
    return r.filter("NOT same").agg(F.count("*").alias("runs"))
