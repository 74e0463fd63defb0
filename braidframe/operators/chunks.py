"""What a path's steps or positions tell one after the other, in chunks: previous steps, prefix sums, runs, merged runs, greedy scans.

A chunk has at most ``CHUNK`` steps (or positions), and only chunks, not paths, meet in one task. What must pass a border passes as a row
a chunk: a guest, a sum, an open run, or the map of a scan. Those rows alone are dealt out by path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..model import before_row


def chunk_of(rank: str = "step_rank") -> Column:
    return F.floor(F.col(rank) / model.CHUNK)


def with_previous(steps: DataFrame, *columns: str) -> DataFrame:
    """``steps`` with each of ``columns`` of the step before as ``previous_*``, null on the first one; ranks have no gaps.

    The last step of a full chunk is also a guest at the start of the next one.
    """
    chunk = chunk_of()
    border = F.col("step_rank") % model.CHUNK == model.CHUNK - 1
    s = steps.withColumn("_c", F.explode(F.when(border, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy("path_id", "_c").orderBy("step_rank")
    s = s.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})
    return s.filter(F.col("_c") == chunk).drop("_c")


def prefix_sum(steps: DataFrame, value: Column, out: str) -> DataFrame:
    """``steps`` with the sum of ``value`` over all earlier steps of the path as ``out``; ranks may have gaps."""
    s = steps.withColumn("_c", chunk_of()).withColumn("_v", value)
    sums = s.groupBy("path_id", "_c").agg(F.sum("_v").alias("_s"))
    bases = sums.withColumn("_base", F.sum("_s").over(before_row(Window.partitionBy("path_id").orderBy("_c")))).filter("_c > 0").select("path_id", "_c", "_base")
    within = F.coalesce(F.sum("_v").over(before_row(Window.partitionBy("path_id", "_c").orderBy("step_rank"))), F.lit(0))
    s = s.withColumn(out, within).join(bases, ["path_id", "_c"], "left").withColumn(out, (F.col(out) + F.coalesce("_base", F.lit(0))).cast("long"))
    return s.drop("_c", "_v", "_base")


def renumbered(steps: DataFrame) -> DataFrame:
    """``steps`` with ranks that have no gaps, in the same order."""
    return prefix_sum(steps, F.lit(1).cast("long"), "_rank").withColumn("step_rank", F.col("_rank")).drop("_rank")


def runs(steps: DataFrame, key: Column) -> DataFrame:
    """Maximal runs of consecutive steps with one ``key``: path_id, key, start, end, n_steps. steps has all of a path's steps with step_start, step_end.

    A chunk's runs are aggregated where they are; those that touch a border of their chunk stay open and are joined to the next chunk's if
    they follow on and have the same key.
    """
    s = steps.select("path_id", "step_rank", "step_start", "step_end", key.alias("key"), chunk_of().alias("_c"))
    w = Window.partitionBy("path_id", "_c").orderBy("step_rank")
    s = s.withColumn("_run", F.sum((~F.lag("key").over(w).eqNullSafe(F.col("key"))).cast("int")).over(w))
    parts = s.groupBy("path_id", "_c", "_run").agg(
        F.first("key").alias("key"), F.min("step_start").alias("start"), F.max("step_end").alias("end"), F.count("*").alias("n_steps"), F.min("step_rank").alias("_lo"), F.max("step_rank").alias("_hi")
    )
    open_ = ((F.col("_c") > 0) & (F.col("_lo") % model.CHUNK == 0)) | (F.col("_hi") % model.CHUNK == model.CHUNK - 1)
    out = ("path_id", "key", "start", "end", "n_steps")
    by_path = Window.partitionBy("path_id").orderBy("_lo")
    follows = (F.lag("_hi").over(by_path) + 1 == F.col("_lo")) & F.lag("key").over(by_path).eqNullSafe(F.col("key"))
    edges = parts.filter(open_).withColumn("_new", F.coalesce(~follows, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(by_path))
    edges = edges.groupBy("path_id", "_g").agg(F.first("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_steps").alias("n_steps"))
    return parts.filter(~open_).select(*out).unionByName(edges.select(*out))


def joined_runs(found: DataFrame, gap: int) -> DataFrame:
    """``found`` (path_id, start, end, n_steps; apart from each other) with those less than ``gap`` base pairs apart made one.

    Runs meet in chunks of positions; the first and the last group of each chunk are then joined along the path.
    """

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start")
        far = F.coalesce(F.col("start") - F.lag("end").over(w) >= gap, F.lit(True))
        df = df.withColumn("_far", far.cast("int")).withColumn("_g", F.sum("_far").over(w))
        return df.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_steps").alias("n_steps"))

    inside = grouped(found.withColumn("_c", F.floor(F.col("start") / model.CHUNK)), "path_id", "_c")
    w = Window.partitionBy("path_id", "_c")
    inside = inside.withColumn("_edge", (F.col("_g") == 1) | (F.col("_g") == F.max("_g").over(w)))
    out = ("path_id", "start", "end", "n_steps")
    return inside.filter("NOT _edge").select(*out).unionByName(grouped(inside.filter("_edge").select(*out), "path_id").select(*out))


def with_next_value(df: DataFrame, value: str, out: str) -> DataFrame:
    """df (path_id, ``value``: distinct numbers) with the path's next larger value, null on the largest."""
    d = df.withColumn("_c", F.floor(F.col(value) / model.CHUNK))
    d = d.withColumn("_next", F.lead(value).over(Window.partitionBy("path_id", "_c").orderBy(value)))
    firsts = df.groupBy("path_id", F.floor(F.col(value) / model.CHUNK).alias("_c")).agg(F.min(value).alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("path_id").orderBy("_c"))).filter("_after IS NOT NULL").select("path_id", "_c", "_after")
    return d.join(after, ["path_id", "_c"], "left").withColumn(out, F.coalesce("_next", "_after")).drop("_c", "_next", "_after")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """Rows with equal first ``keys`` columns, which come together, as (keys, the other columns); one group at most is held.

    All columns are longs without nulls.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        new = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:keys]:
            new |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(new) + 1]
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield tuple(int(c[lo]) for c in columns[:keys]), [c[lo:hi] for c in columns[keys:]]
        held = [c[starts[-1] :] for c in columns]
    if held is not None:
        yield tuple(int(c[0]) for c in held[:keys]), held[keys:]


def _sent(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def chunk_map(p: np.ndarray, base: int, apart: int) -> tuple[list[int], list[int]]:
    """What a chunk of a greedy scan does to any position carried in.

    p: the chunk's positions in order, all at ``base`` or beyond; the last position kept before lies below ``base``. Of the result (upto,
    last): if the first position that may be kept is upto[i] at most, and above upto[i - 1], the chunk's last kept position is
    last[i]; beyond all of upto nothing is kept. There are no more than ``apart`` + 1 entries, whatever the chunk holds.
    """
    n = len(p)
    jump = np.searchsorted(p, p + apart)
    end = np.where(jump < n, jump, np.arange(n))
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    some = min(n, int(np.searchsorted(p, base + apart)) + 1)
    upto, last = p[:some], p[end[:some]]
    keep = np.r_[last[1:] != last[:-1], True]
    return upto[keep].tolist(), last[keep].tolist()


_MAPS = pa.schema([("path_id", pa.int64()), ("chunk", pa.int64()), ("upto", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
_CARRIED = pa.schema([("path_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.int64())])
_KEPT = pa.schema([("path_id", pa.int64()), ("pos", pa.int64())])
_NONE = -(1 << 62)


def greedy_scan(points: DataFrame, apart: int, before: int | None = None, span: int | None = None) -> DataFrame:
    """points (path_id, pos; longs, not null) that a scan along each path keeps: those at least ``apart`` behind the last one kept.

    ``before`` stands for one kept before the first; without it the first is kept. Three passes: every chunk of ``span`` positions is
    turned into its map from the position carried in to the one carried out; the maps of a path are applied one after the other
    (a row for each chunk); the chunks are replayed with what is carried into them. ``apart`` must be 1 at least, and repeated
    positions count once.
    """
    span = span or max(model.CHUNK, 4 * apart)
    start = _NONE if before is None else before
    d = points.select(F.col("path_id").cast("long").alias("path_id"), F.floor(F.col("pos") / span).cast("long").alias("chunk"), F.col("pos").cast("long").alias("pos"))
    keys = ("path_id", "chunk")

    def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, chunk, *chunk_map(np.unique(p), chunk * span, apart)) for (path, chunk), (p,) in _groups(batches, 2))
        return _sent(rows, _MAPS, 2000)

    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, last = None, start
            for batch in batches:
                for own, chunk, upto, outs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if own != path:
                        path, last = own, start
                    elif last != _NONE:
                        yield path, chunk, last
                    at = int(np.searchsorted(upto, last + apart))
                    last = outs[at] if at < len(outs) else last

        return _sent(rows(), _CARRIED)

    def replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (path, _), (p, carried) in _groups(batches, 2):
                # a row that carries has no position of its own and comes first
                last = int(carried[0]) if carried[0] != _NONE else start
                p = p[carried == _NONE]
                at = int(np.searchsorted(p, last + apart))
                while at < len(p):
                    last = int(p[at])
                    yield path, last
                    at = int(np.searchsorted(p, last + apart))

        return _sent(rows(), _KEPT)

    # only chunks of paths with several have something to carry
    several = d.groupBy("path_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a < b").select("path_id")
    m = d.join(several, "path_id", "left_semi").repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(maps, "path_id long, chunk long, upto array<long>, last array<long>")
    carried = m.repartition("path_id").sortWithinPartitions(*keys).mapInArrow(composed, "path_id long, chunk long, last long")
    none = F.lit(_NONE).cast("long")
    both = d.select(*keys, "pos", none.alias("carried")).union(carried.select(*keys, none, "last"))
    return both.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(replayed, "path_id long, pos long")
