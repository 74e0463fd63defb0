"""Counts and summaries of a graph: sizes, depth, degree, base content, sharing classes, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import name_prefix, trimmed, uncalled
from ..model import Graph, with_next
from .chunks import with_previous


def _long(c: Column) -> Column:
    return c.cast("long")


def _one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def summary(g: Graph) -> DataFrame:
    n = g.nodes.agg(_long(F.coalesce(F.sum("len"), F.lit(0))).alias("length"), F.count("*").alias("nodes"))
    return _one_row(n, g.edges.agg(F.count("*").alias("edges")), g.paths.agg(F.count("*").alias("paths")), g.steps.agg(F.count("*").alias("steps")))


def base_content(g: Graph) -> DataFrame:
    chars = g.nodes.select(F.explode(F.split("seq", "")).alias("base")).filter("base != ''")
    return chars.groupBy("base").agg(F.count("*").alias("n"))


def depth_table(g: Graph, subset: DataFrame | None = None) -> DataFrame:
    """node_id, depth (steps), depth_uniq (paths), over all paths or those of ``subset`` (path_id)."""
    s = g.steps if subset is None else g.steps.join(subset.select("path_id"), "path_id", "left_semi")
    per = s.groupBy("node_id", "path_id").agg(F.count("*").alias("c")).groupBy("node_id").agg(F.sum("c").alias("depth"), F.count("*").alias("depth_uniq"))
    return g.nodes.select("node_id").join(per, "node_id", "left").select("node_id", _long(F.coalesce("depth", F.lit(0))).alias("depth"), _long(F.coalesce("depth_uniq", F.lit(0))).alias("depth_uniq"))


def depth_summary(g: Graph) -> DataFrame:
    d = g.nodes.join(depth_table(g), "node_id").agg(
        F.count("*").alias("node_count"), _long(F.sum("len")).alias("graph_length"), _long(F.sum("depth")).alias("step_count"), _long(F.sum(F.col("depth") * F.col("len"))).alias("path_length")
    )
    return d.withColumn("mean_node_depth", F.col("step_count") / F.col("node_count")).withColumn("mean_graph_depth", F.col("path_length") / F.col("graph_length"))


def degree_table(g: Graph) -> DataFrame:
    """node_id, degree, degree_in (left side), degree_out (right side)."""
    a = g.adjacency().groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("src_rev").cast("int")).alias("i"), F.sum((~F.col("src_rev")).cast("int")).alias("o"))
    d = g.nodes.select("node_id").join(a, "node_id", "left")
    i, o = _long(F.coalesce("i", F.lit(0))), _long(F.coalesce("o", F.lit(0)))
    return d.select("node_id", (i + o).alias("degree"), i.alias("degree_in"), o.alias("degree_out"))


def degree_summary(g: Graph) -> DataFrame:
    d = degree_table(g).agg(F.count("*").alias("node_count"), _long(F.sum("degree")).alias("s"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    return d.select("node_count", _long(F.floor(F.col("s") / 2)).alias("edge_count"), (F.col("s") / F.col("node_count")).alias("avg_degree"), "min_degree", "max_degree")


def subset_degree(g: Graph, subset: DataFrame) -> DataFrame:
    """Degrees, 0 on nodes that no path of ``subset`` touches."""
    touched = g.steps.join(subset.select("path_id"), "path_id", "left_semi").select("node_id").distinct().withColumn("t", F.lit(True))
    return degree_table(g).join(touched, "node_id", "left").select("node_id", F.when(F.col("t"), F.col("degree")).otherwise(0).alias("degree"))


def base_vector(g: Graph, values: DataFrame, value: str) -> DataFrame:
    """path_id, v: ``value`` of the node under every base pair of a path (runs of equal steps repeated by length)."""
    s = g.steps.join(g.lengths(), "node_id").join(values.select("node_id", value), "node_id")
    ordered = F.array_sort(F.collect_list(F.struct("step_rank", F.col(value).alias("v"), "len")))
    return s.groupBy("path_id").agg(F.flatten(F.transform(ordered, lambda x: F.array_repeat(x["v"], x["len"].cast("int")))).alias("v"))


def self_visits(g: Graph) -> DataFrame:
    """path_id, step_rank, node_id, self_depth (visits of the node by the same path), self_degree (degree times those)."""
    w = Window.partitionBy("path_id", "node_id")
    s = g.steps.withColumn("self_depth", F.count("*").over(w)).join(degree_table(g).select("node_id", "degree"), "node_id")
    return s.select("path_id", "step_rank", "node_id", "self_depth", (F.col("self_depth") * F.col("degree")).alias("self_degree"))


def sample_of(g: Graph, delimiter: str = "#", fields: int = 1) -> DataFrame:
    return g.paths.select("path_id", name_prefix(F.col("path_name"), delimiter, fields).alias("sample"))


def visits_by_sample(g: Graph, delimiter: str = "#", fields: int = 1) -> DataFrame:
    """node_id, sample, cnt: visits of each node by each group of paths, counted before anything is joined."""
    return g.steps.join(sample_of(g, delimiter, fields), "path_id").groupBy("node_id", "sample").agg(F.count("*").alias("cnt"))


def sharing(g: Graph, delimiter: str = "#", fields: int = 1) -> DataFrame:
    """sample, core, private, shell: base pairs of its nodes that all, one and some samples visit."""
    v = visits_by_sample(g, delimiter, fields)
    total = v.agg(F.countDistinct("sample").alias("all"))
    per = v.groupBy("node_id").agg(F.count("*").alias("k"))
    kind = F.when(F.col("k") == 1, "private").when(F.col("k") == F.col("all"), "core").otherwise("shell")
    d = v.join(per, "node_id").join(g.lengths(), "node_id").crossJoin(total).withColumn("kind", kind)
    return d.groupBy("sample").agg(*[_long(F.sum(F.when(F.col("kind") == k, F.col("len")).otherwise(0))).alias(k) for k in ("core", "private", "shell")])


def self_loops(g: Graph) -> DataFrame:
    return g.edges.filter("from_id = to_id").agg(F.count("*").alias("total"), F.countDistinct("from_id").alias("unique_nodes"))


def nondeterministic_edges(g: Graph) -> DataFrame:
    """Oriented edges among several from one oriented node whose targets begin with the same character."""
    from ..functions.dna import oriented

    a = g.adjacency().join(g.nodes.select(F.col("node_id").alias("dst"), "seq"), "dst")
    a = a.withColumn("first_base", F.substring(oriented(F.col("seq"), F.col("dst_rev")), 1, 1))
    w = Window.partitionBy("src", "src_rev", "first_base")
    return a.withColumn("n", F.count("*").over(w)).filter("n > 1").select("src", "src_rev", "dst", "dst_rev", "first_base")


def invalid_steps(g: Graph) -> DataFrame:
    """Consecutive steps without an edge between them."""
    t = g.transitions()
    return t.join(g.adjacency(), ["src", "src_rev", "dst", "dst_rev"], "left_anti").select("path_id", "step_rank", "src", "src_rev", "dst", "dst_rev")


def haplotype_matrix(g: Graph, scaled: bool = False) -> DataFrame:
    """path_id, node_id, visits in long form, times the node's length if ``scaled``."""
    m = g.steps.groupBy("path_id", "node_id").agg(F.count("*").alias("visits"))
    return m if not scaled else m.join(g.lengths(), "node_id").select("path_id", "node_id", (F.col("visits") * F.col("len")).alias("visits"))


def haplotype_blocks(g: Graph, min_paths: int = 1, min_depth: int = 1) -> DataFrame:
    """node_id, path_id, visits of at least ``min_depth``, on nodes where at least ``min_paths`` paths have that many, but not all paths."""
    v = haplotype_matrix(g).filter(F.col("visits") >= min_depth)
    n = v.groupBy("node_id").agg(F.count("*").alias("k")).filter(F.col("k") >= min_paths)
    n = n.crossJoin(g.paths.agg(F.count("*").alias("all"))).filter("k != all").select("node_id")
    return v.join(n, "node_id", "left_semi").select("node_id", "path_id", "visits")


def coverage_classes(g: Graph, levels: Sequence[float] = (1, 3), fraction: bool = False) -> DataFrame:
    """node_id, len, class: samples on the node, or their share of all, between the levels."""
    v = visits_by_sample(g)
    c = g.nodes.select("node_id", "len").join(v.groupBy("node_id").agg(F.count("*").alias("k")), "node_id", "left").withColumn("k", F.coalesce("k", F.lit(0)).cast("double"))
    if fraction:
        c = c.crossJoin(v.agg(F.countDistinct("sample").alias("all"))).withColumn("k", F.col("k") / F.col("all"))
    cuts = [F.lit(float(x)) for x in levels]
    label = F.when(F.col("k") < cuts[0], F.concat(F.lit("c<"), trimmed(cuts[0])))
    for lo, hi in zip(cuts, cuts[1:]):
        label = label.when(F.col("k") < hi, F.concat(trimmed(lo), F.lit("<=c<"), trimmed(hi)))
    return c.select("node_id", "len", label.otherwise(F.concat(F.lit("c>="), trimmed(cuts[-1]))).alias("class"))


def non_reference_nodes(g: Graph, reference: DataFrame, min_size: int = 0) -> DataFrame:
    """node_id, len, uncalled, paths of nodes on no path of ``reference``."""
    on = g.steps.join(reference.select("path_id"), "path_id", "left_semi").select("node_id").distinct()
    names = g.steps.join(g.paths.select("path_id", "path_name"), "path_id").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("path_name")), ",").alias("paths"))
    n = g.nodes.join(on, "node_id", "left_anti").filter(F.col("len") >= min_size)
    return n.join(names, "node_id", "left").select("node_id", "len", uncalled(F.col("seq")).alias("uncalled"), F.coalesce("paths", F.lit("")).alias("paths"))


def matrix(g: Graph, weight: str = "one") -> DataFrame:
    """src, dst, weight: every edge both ways; weight one, path traversals (``visits``) or inverse id distance (``delta``)."""
    e = g.edges
    if weight == "visits":
        from ..model import canonical

        t = g.transitions().select(canonical(F.col("src"), F.col("src_rev"), F.col("dst"), F.col("dst_rev")).alias("e")).groupBy("e").agg(F.count("*").alias("n")).select("e.*", "n")
        e = e.join(t, ["from_id", "from_rev", "to_id", "to_rev"], "left").withColumn("weight", F.coalesce("n", F.lit(0)).cast("double"))
    elif weight == "delta":
        e = e.withColumn("weight", F.when(F.col("from_id") == F.col("to_id"), 0.0).otherwise(F.lit(1.0) / F.abs(F.col("from_id") - F.col("to_id"))))
    else:
        e = e.withColumn("weight", F.lit(1.0))
    return e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "weight").union(e.select(F.col("to_id"), F.col("from_id"), "weight"))


def _link_ends(g: Graph) -> DataFrame:
    """Transitions with the graph coordinates of the touching ends and both nodes' ranks and lengths."""
    n = g.pan_positions().select("node_id", "node_rank", "len", "pan_start")
    t = g.transitions()
    a = n.select(F.col("node_id").alias("src"), F.col("node_rank").alias("ra"), F.col("len").alias("la"), F.col("pan_start").alias("pa"))
    b = n.select(F.col("node_id").alias("dst"), F.col("node_rank").alias("rb"), F.col("len").alias("lb"), F.col("pan_start").alias("pb"))
    t = t.join(a, "src").join(b, "dst")
    leave = F.when(F.col("src_rev"), F.col("pa")).otherwise(F.col("pa") + F.col("la"))
    enter = F.when(F.col("dst_rev"), F.col("pb") + F.col("lb")).otherwise(F.col("pb"))
    return t.withColumn("nt", F.abs(enter - leave)).withColumn("node_gap", F.abs(F.col("rb") - F.col("ra")))


def mean_links_length(g: Graph) -> DataFrame:
    """path, in_node_space, in_nucleotide_space, num_links, with a row ``all_paths``."""
    t = _link_ends(g)
    per = t.groupBy("path_id").agg(F.sum("node_gap").alias("a"), F.sum("nt").alias("b"), F.count("*").alias("n")).join(g.paths.select("path_id", "path_name"), "path_id")
    rows = per.select(F.col("path_name").alias("path"), "a", "b", "n").union(per.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).select(F.lit("all_paths"), "a", "b", "n"))
    return rows.select("path", (F.col("a") / F.col("n")).alias("in_node_space"), (F.col("b") / F.col("n")).alias("in_nucleotide_space"), _long(F.col("n")).alias("num_links"))


def sum_path_distances(g: Graph, backward: int = 3, flipped: int = 2) -> DataFrame:
    """path_id, distance: node rank distances along the path, backward ones weighing three, two more where the strand flips."""
    t = _link_ends(g)
    w = F.when(F.col("rb") < F.col("ra"), backward).otherwise(1) + F.when(F.col("src_rev") != F.col("dst_rev"), flipped).otherwise(0)
    return t.groupBy("path_id").agg(_long(F.sum(F.col("node_gap") * w)).alias("distance"), F.count("*").alias("num_links"))


def feedback_and_reversals(g: Graph) -> DataFrame:
    """feedback_arcs (steps on one strand that do not go forward) and reversing_joins (strand changes)."""
    t = _link_ends(g)
    same = F.col("src_rev") == F.col("dst_rev")
    back = F.when(F.col("src_rev"), F.col("rb") >= F.col("ra")).otherwise(F.col("rb") <= F.col("ra"))
    return t.agg(F.count(F.when(same & back, 1)).alias("feedback_arcs"), F.count(F.when(~same, 1)).alias("reversing_joins"))


def links_per_nucleotide(g: Graph, skip_gaps: bool = True) -> DataFrame:
    """Sum of link gaps over the paths' base pairs; forward links over nodes that the path leaves out do not count."""
    t = _link_ends(g)
    gap = ~F.col("src_rev") & ~F.col("dst_rev") & (F.col("rb") > F.col("ra"))
    total = t.agg(F.sum(F.when(gap & F.lit(skip_gaps), 0).otherwise(F.col("nt"))).alias("gaps"))
    return _one_row(total, g.path_lengths().agg(F.sum("path_len").alias("bp"))).select(_long(F.col("gaps")).alias("gaps"), (F.col("gaps") / F.col("bp")).alias("links_per_nt"))


def kth_occurrence(g: Graph) -> DataFrame:
    """Each step with its number among the path's visits of the node, and the steps before and after among them."""
    w = Window.partitionBy("path_id", "node_id").orderBy("step_rank")
    return g.steps.select("path_id", "step_rank", "node_id", F.row_number().over(w).cast("long").alias("k"), F.lag("step_rank").over(w).alias("prev_visit"), F.lead("step_rank").over(w).alias("next_visit"))


def path_list(g: Graph) -> DataFrame:
    """path_name, start, length of every path; paths without steps are 0 long."""
    p = g.paths.join(g.path_lengths(), "path_id", "left")
    return p.select("path_name", F.lit(1).cast("long").alias("start"), _long(F.coalesce("path_len", F.lit(0))).alias("length"))


def flatten(g: Graph, name: str) -> DataFrame:
    """The steps as intervals of the concatenated nodes, which are called ``name``: name start end path strand rank."""
    n = g.pan_positions().select("node_id", "len", "pan_start")
    s = g.steps.join(n, "node_id").join(g.paths.select("path_id", "path_name"), "path_id")
    return s.select(F.lit(name).alias("name"), F.col("pan_start").alias("start"), (F.col("pan_start") + F.col("len")).alias("end"), "path_name", F.when(F.col("is_rev"), "-").otherwise("+").alias("strand"), "step_rank")


def fasta(g: Graph) -> DataFrame:
    """path_name, sequence of every path with steps."""
    from ..functions.dna import oriented

    s = g.steps.join(g.nodes.select("node_id", "seq"), "node_id").select("path_id", "step_rank", oriented(F.col("seq"), F.col("is_rev")).alias("s"))
    seq = s.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_rank", "s"))), lambda x: x["s"]), "").alias("sequence"))
    return g.paths.select("path_id", "path_name").join(seq, "path_id").select("path_name", "sequence")


def heaps(g: Graph, permutations: int = 3, seed: str = "heaps", delimiter: str = "#", fields: int = 1) -> DataFrame:
    """permutation, nth_genome, base_pairs: length of the nodes seen after n groups in a keyed random order."""
    v = visits_by_sample(g, delimiter, fields).select("node_id", "sample")
    groups = sample_of(g, delimiter, fields).select("sample").distinct()
    p = groups.crossJoin(g.spark.range(permutations).select(F.col("id").alias("permutation")))
    order = Window.partitionBy("permutation").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("permutation").cast("string"), F.col("sample"))), "sample")
    p = p.withColumn("nth_genome", F.row_number().over(order).cast("long"))
    few = F.broadcast(p) if permutations <= 100 else p
    first = v.join(few, "sample").groupBy("permutation", "node_id").agg(F.min("nth_genome").alias("nth_genome"))
    new = first.join(g.lengths(), "node_id").groupBy("permutation", "nth_genome").agg(F.sum("len").alias("bp"))
    total = F.sum(F.coalesce("bp", F.lit(0))).over(Window.partitionBy("permutation").orderBy("nth_genome"))
    return p.join(new, ["permutation", "nth_genome"], "left").select("permutation", "nth_genome", _long(total).alias("base_pairs"))


def step_navigation(g: Graph) -> DataFrame:
    """Each step with the steps before and after it on its path."""
    s = with_next(with_previous(g.steps.select("path_id", "step_rank", "node_id"), "node_id"), "node_id")
    return s.select("path_id", "step_rank", "node_id", F.col("previous_node_id").alias("prev_node"), F.col("next_node_id").alias("next_node"))
