"""SimHash near duplicates: fingerprints within a few bits of each other, found by a generalised pigeonhole.

1. Every text's fingerprint has the bits that over half of its shingles' XXH64 hashes have. Equal fingerprints are one from here on, so
   copies cost nothing further.
2. Bits that go together are grouped into one partition of 16, by their correlation over all distinct fingerprints (a 64 by 64 matrix
   that tasks add up), so that the partitions differ in what they tell. Fingerprints are kept with their bits in this order.
3. Two fingerprints at ``t`` bits at most lie within ``t_i`` bits of each other in some partition ``i`` if the t_i (-1 at least) add up to
   t - 3. From the histograms of all partition values (4 times 65,536 counts whatever the input) each task knows how many fingerprints
   lie within any distance of any value, and dynamic programming gives every fingerprint the thresholds with the fewest candidates and
   probes. A value that many share is left out (-1) where a wider ball elsewhere is cheaper.
4. Every fingerprint stands in the bucket of each of its partition values, and probes those within its thresholds. Buckets of more than
   ``MOST_ROWS`` rows are refined: the bits that are left are cut into 4 partitions again, of which near ones must share one, until
   every bucket is small; where no more than ``t`` bits are left there can only be few. So a hot value ends in many small buckets,
   nothing is capped, and no task holds more than one bucket.
5. All pairs of a bucket are verified by their differing bits; what leaves it are enough links to join what they join, not all of them. Alternating
   stars then give the components.

Defined results: null and empty texts and those without words have the fingerprint zero and are linked as any other; fewer words than
a shingle are hashed as a whole; texts of any length are read whole; repeated rows are rows of one fingerprint; a null doc_id is linked
but is nobody's component id unless all are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written
from .components import components

BITS, THRESHOLD, SHINGLE, SEED = 64, 3, 3, 42
PARTS = 4
WIDTH = BITS // PARTS
#: Rows of a bucket that is compared as it is; larger ones are refined.
MOST_ROWS = 4096
#: What a probe costs, in candidates.
PROBE_COST = 8
_AT_ONCE = 1 << 16


def fingerprint(data: bytes) -> int:
    """Unsigned 64 bits. ``bytes.lower`` changes A-Z alone, ``bytes.split`` splits at the six ASCII white-space bytes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -SHINGLE] + 1].tolist()
    text, n = b" ".join(words), len(words) - SHINGLE + 1
    ends = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _AT_ONCE):
        some = zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])
        h = np.fromiter((digest(text[s:e], SEED) for s, e in some), np.uint64, min(_AT_ONCE, n - at))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], schema=_PRINTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _longs(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column(k)).astype(np.int64).view(np.uint64)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(prints: DataFrame) -> np.ndarray:
    """For every two bits the number of fingerprints (fp) that have both, by adding up the tasks' matrices: 64 x 64 whatever the input."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = _longs(batch, 0)
            for at in range(0, len(x), _AT_ONCE):
                b = _bits(x[at : at + _AT_ONCE]).astype(np.float32)
                total += (b.T @ b).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["k", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for r in prints.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out.reshape(BITS, BITS)


def grouped_bits(both: np.ndarray, n: int) -> list[int]:
    """The bits in their new order: ``PARTS`` groups of ``WIDTH``, each grown from the bit with most correlation to those that are left."""
    ones = np.diag(both).astype(float)
    spread = np.sqrt(np.maximum(ones * (n - ones), 1))
    like = np.abs(n * both - np.outer(ones, ones)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    left, out = list(range(BITS)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            nxt = max(left, key=lambda b: (like[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        out += group
    return out


def reordered(prints: DataFrame, order: list[int]) -> DataFrame:
    """``prints`` (fp, first_id) with y, the fingerprint with its bits in ``order``, lowest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _longs(batch, 0)
            y = np.zeros(len(x), np.uint64)
            for to, at in enumerate(order):
                y |= (x >> np.uint64(at) & np.uint64(1)) << np.uint64(to)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y.view(np.int64))], names=["fp", "first_id", "y"])

    return prints.select("fp", "first_id").mapInArrow(run, "fp long, first_id long, y long")


def field(y: np.ndarray, part: int) -> np.ndarray:
    return (y >> np.uint64(part * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def histograms(prints: DataFrame) -> np.ndarray:
    """PARTS x 2^WIDTH counts of the partition values of ``y``."""
    value = lambda i: F.shiftrightunsigned("y", i * WIDTH).bitwiseAND((1 << WIDTH) - 1)
    out = np.zeros((PARTS, 1 << WIDTH), np.int64)
    at = prints.select(F.posexplode(F.array(*[value(i) for i in range(PARTS)])).alias("part", "value")).groupBy("part", "value").agg(F.count("*").alias("n"))
    t = at.toArrow()
    out[np.asarray(t["part"]), np.asarray(t["value"])] = np.asarray(t["n"])
    return out


def within(counts: np.ndarray, most: int) -> np.ndarray:
    """For one partition's ``counts`` the number of fingerprints within 0, 1, ... ``most`` bits of every value."""
    exact = np.zeros((most + 1, len(counts)), np.int64)
    exact[0] = counts
    values = np.arange(len(counts))
    for b in range(WIDTH):
        exact[1:] += exact[:, values ^ (1 << b)][:-1]
    return exact.cumsum(0)


def flips(most: int) -> list[np.ndarray]:
    """The masks of 0, 1, ... ``most`` of WIDTH bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), k)], np.uint64) for k in range(most + 1)]


def costs(counts: np.ndarray, threshold: int) -> np.ndarray:
    """PARTS x (threshold + 2) x 2^WIDTH: the cost of the thresholds -1, 0, ... at every value: candidates, and probes."""
    probes = np.cumsum([len(m) for m in flips(threshold)])
    near = np.stack([within(c, threshold) for c in counts])
    return np.concatenate([np.zeros_like(near[:, :1]), near + PROBE_COST * probes[None, :, None]], 1)


def allocated(y: np.ndarray, cost: np.ndarray, threshold: int) -> np.ndarray:
    """len(y) x PARTS: the thresholds of each fingerprint, plus one, that cost least and add up to threshold + 1."""
    goal = threshold + 1
    best = np.full((len(y), goal + 1), np.iinfo(np.int64).max // 4)
    best[:, 0] = 0
    taken = []
    for i in range(PARTS):
        own = cost[i][:, field(y, i)]
        now, choice = np.full_like(best, np.iinfo(np.int64).max // 4), np.zeros(best.shape, np.int8)
        for k in range(goal + 1):
            for b in range(k, goal + 1):
                c = best[:, b - k] + own[k]
                better = c < now[:, b]
                now[better, b] = c[better]
                choice[better, b] = k
        best = now
        taken.append(choice)
    out, left, rows = np.zeros((len(y), PARTS), np.int64), np.full(len(y), goal), np.arange(len(y))
    for i in reversed(range(PARTS)):
        out[:, i] = taken[i][rows, left]
        left = left - out[:, i]
    return out


_ROWS_SQL = "path long, value long, y long"


def _rows(path: np.ndarray, value: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(value.view(np.int64)), pa.array(y.view(np.int64))], names=["path", "value", "y"])


def part_mask(part: int) -> np.uint64:
    return np.uint64(((1 << WIDTH) - 1) << part * WIDTH)


def probed(prints: DataFrame, counts: np.ndarray, threshold: int) -> DataFrame:
    """path, value, y: every fingerprint in its own buckets and in those that it probes. path is 4 + partition, value the bits in place."""
    sent = prints.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, masks = costs(sent.value, threshold), flips(threshold)
        for batch in batches:
            whole = _longs(batch, 0)
            for at in range(0, len(whole), 4096):
                y = whole[at : at + 4096]
                k = allocated(y, cost, threshold)
                for i in range(PARTS):
                    v = y & part_mask(i)
                    path = np.full(len(y), PARTS + i, np.int64)
                    yield _rows(path, v, y)
                    for t in range(1, threshold + 1):
                        on = k[:, i] > t
                        for m in masks[t] << np.uint64(i * WIDTH) if on.any() else ():
                            yield _rows(path[on], v[on] ^ m, y[on])

    return prints.select("y").mapInArrow(run, _ROWS_SQL)


def left_fields(path: int, parts: int = PARTS) -> list[np.uint64]:
    """The masks of the partitions into which the bits that ``path`` leaves are cut."""
    digits = []
    while path >= parts:
        path, d = divmod(path, parts)
        digits.append(d)
    bits = list(range(BITS))
    for d in [*reversed(digits), None]:
        cuts = [len(bits) * k // parts for k in range(parts + 1)]
        fields = [bits[a:b] for a, b in zip(cuts, cuts[1:])]
        if d is None:
            return [np.uint64(sum(1 << b for b in f)) for f in fields]
        bits = [b for k, f in enumerate(fields) if k != d for b in f]
    raise AssertionError


def deepest(threshold: int) -> int:
    """Paths from here on leave ``threshold`` bits at most, if the smallest partition is taken each time."""
    bits, levels = BITS, 0
    while bits > threshold:
        bits -= max(1, bits // PARTS)
        levels += 1
    return PARTS**levels


def refined(rows: DataFrame) -> DataFrame:
    """Each row once for each partition of the bits that its path leaves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, value, y = np.asarray(batch.column(0)).astype(np.int64), _longs(batch, 1), _longs(batch, 2)
            for p in np.unique(path):
                on = path == p
                for j, mask in enumerate(left_fields(int(p))):
                    yield _rows(np.full(int(on.sum()), int(p) * PARTS + j), value[on] | (y[on] & mask), y[on])

    return rows.select("path", "value", "y").mapInArrow(run, _ROWS_SQL)


def joining(y: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of one bucket that join what all its links join, by searching on from each member that was reached."""
    a, b = [], []
    left = np.arange(len(y))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(y[front[:256], None] ^ y[left]) <= threshold
            hit = near.any(0)
            a.append(front[:256][near.argmax(0)[hit]])
            b.append(left[hit])
            front, left = np.concatenate([front[256:], left[hit]]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


#: Buckets up to this size are compared all at once, by offset.
SMALL = 16


def verified(rows: DataFrame, threshold: int) -> DataFrame:
    """a, b: links between fingerprints that share a bucket, enough to join what all of them join."""

    def links(path: np.ndarray, value: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])])
        sizes = np.diff(np.r_[starts, len(y)])
        a, b = [], []
        bucket = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        ys, bs = y[small], bucket[small]
        for lag in range(1, SMALL):
            if len(ys) <= lag:
                break
            on = np.flatnonzero((bs[lag:] == bs[:-lag]) & (np.bitwise_count(ys[lag:] ^ ys[:-lag]) <= threshold))
            a.append(ys[on])
            b.append(ys[on + lag])
        for k in np.flatnonzero(sizes > SMALL):
            own = y[starts[k] : starts[k] + sizes[k]]
            i, j = joining(own, threshold)
            a.append(own[i])
            b.append(own[j])
        if a and len(out := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            path, value, y = (np.concatenate([h, x]) for h, x in zip(held, (np.asarray(batch.column(0)).astype(np.int64), _longs(batch, 1), _longs(batch, 2))))
            last = int(np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])])[-1])
            if last:
                yield from links(path[:last], value[:last], y[:last])
            held = [x[last:].copy() for x in (path, value, y)]
        if len(held[0]):
            yield from links(*held)

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "path", "value").sortWithinPartitions("path", "value")
    return dealt.mapInArrow(run, "a long, b long")


def bucketed(prints: DataFrame, threshold: int = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """path, value, y in buckets of ``most_rows`` rows at most, where more than ``threshold`` bits are left."""
    rows, out = written(probed(prints, histograms(prints), threshold)), None
    while True:
        hot = written(rows.filter(F.col("path") < deepest(threshold)).groupBy("path", "value").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).drop("n"))
        if hot.isEmpty():
            return rows if out is None else out.union(rows)
        cold = rows.join(hot, ["path", "value"], "left_anti").select("path", "value", "y")
        out = cold if out is None else out.union(cold)
        rows = written(refined(rows.join(hot, ["path", "value"], "left_semi")))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links) of every row of ``docs``."""
    rows = written(fingerprints(docs))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    order = grouped_bits(together(prints), max(1, prints.count()))
    prints = written(reordered(prints, order))
    roots = components(verified(bucketed(prints, threshold, most_rows), threshold).distinct())
    linked = prints.join(roots, prints["y"] == roots["node"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = prints.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
