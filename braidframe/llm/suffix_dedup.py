"""Removal of passages that an earlier document has, to the byte, with suffix arrays over what documents may share.

A byte goes if it lies in a ``width``-byte string that also starts in a document with a smaller doc_id. All is judged on the input.

1. Copies of a whole text are settled by the text's hash.
2. Of the ``gram``-byte strings of every window of ``width`` bytes the one with the smallest hash is the window's anchor, so equal
   windows have equal anchors. Each anchor row carries hashes of its surroundings: of the fragment in which all its windows lie,
   and of the anchor with 17 more bytes to its left and to its right, one of which lies within any window. Rows are dealt out by
   anchor and streamed in order: a fragment that an earlier document has too is covered whole, which two separate hashes of 64 bits
   decide and no comparison of bytes; of the rest only those stay whose left or right side another document has too. There and for
   the anchors 32 bits do, as the bytes of what stays are compared.
3. The bytes of these are cut from the texts and dealt out by side. A side with more than ``MOST_FRAGMENTS`` fragments is split: its windows
   are those with ``lo`` to ``hi`` bytes before the anchor, which all hold the bytes from ``lo`` before it on, and each half of that range holds more, by
   which it is dealt out anew; where one window is left, all bytes are the key and the smallest doc_id comes first. A suffix array is built over each bounded run of groups by two-stage sorting: suffixes smaller than
   their successors are sorted directly, the rest induced by bucket scans; adjacent common prefixes of ``width`` bytes or more then
   give the strings that fragments share, and the smallest doc_id of each.

Defined results: null text is empty; texts shorter than ``width`` lose nothing; a text of any length is searched
whole; rows that share a doc_id do not remove each other's
bytes, and each is judged by itself under a key of its own (the doc_id where no two rows share one, else a number written with the row); a null doc_id comes after all others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, whole_text, written

WIDTH, GRAM, SIDE = 50, 16, 17
MOST_BROADCAST_IDS = 1_000_000
_LAST = (1 << 63) - 1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S32)) * _M2
        h = (h ^ (h >> _S29)) * _M3
        return h ^ (h >> _S32)


def words8(data: bytes) -> np.ndarray:
    """The 8 bytes at every position, little-endian, zeros beyond the end."""
    return np.ndarray((len(data),), "<u8", data + bytes(8), 0, (1,)).astype(np.uint64)


def gram_hashes(w: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte strings from :func:`words8`."""
    m = len(w) - gram + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = w[:m] * _M1
        at = 8
        while at < gram:
            o = min(at, gram - 8)
            h = (h ^ (h >> _S29)) * _M1 + w[o : o + m]
            at += 8
    return _mixed(h)


def _sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    y, step = x, 1
    while 2 * step <= width:
        y = f(y[: len(y) - step], y[step:])
        step *= 2
    return f(y[: len(y) - (width - step)], y[width - step :]) if step < width else y


def anchors(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some window (all of equal ones), from :func:`gram_hashes`."""
    span = width - gram + 1
    if len(h) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pad = np.zeros(span - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([pad, _sliding(np.minimum, h, span), pad]), span)
    at = np.flatnonzero(h == best)
    return at, h[at]


def chained(h: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = 2 * WIDTH - GRAM, gram: int = GRAM) -> np.ndarray:
    """Hashes of byte ranges of ``gram`` to ``longest`` bytes, from the hashes of grams that cover them: apart from :class:`Surroundings`."""
    with np.errstate(over="ignore"):
        out = (end - start).astype(np.uint64)
        for o in range(0, longest, gram):
            out = (out ^ (out >> _S29)) * _M1 + h[np.minimum(start + o, end - gram)]
        return _mixed(out)


class Surroundings:
    """Hashes of byte ranges in constant time: sums of table values times powers of an odd base, modulo 2^64."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 2 * len(self.powers))
            base = int(_M1)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(base))])
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(base, -1, 1 << 64)))])

    def __call__(self, data: bytes, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        n = len(data)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[np.frombuffer(data, np.uint8)] * self.inverse[:n], out=sums[1:])
            return [_mixed((sums[end] - sums[start]) * self.powers[start] + (end - start).astype(np.uint64)) for start, end in ranges]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_ANCHOR_FIELDS = ("frag", "frag2", "sides", "ord", "pos")
#: Rows of one anchor that a task holds to compare their sides; of more, all go on to the suffix arrays uncompared.
MOST_HELD = 2_000_000
#: Fragments of one side that meet; sides with more are split.
MOST_FRAGMENTS = 20_000


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs: ord, text, and uid if rows share an ord. A row per anchor: its hash, two of its fragment, those of its sides (32 bits each), and where it is."""
    keyed = "uid" in docs.columns
    fields = (*_ANCHOR_FIELDS, *(["uid"] if keyed else []))
    schema = pa.schema([("anchor", pa.int32()), *[(c, pa.int64()) for c in fields]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Surroundings()
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(fields))]
                ids = zip(*(batch.column(c).to_pylist() for c in fields[4 - 1 :] if c != "pos"))
                for own, data in zip(ids, _bytes(batch.column("text"))):
                    grams = gram_hashes(words8(data), GRAM)
                    at, h = anchors(grams)
                    if not len(at):
                        continue
                    n = len(data)
                    ends = [(np.maximum(at - (WIDTH - GRAM), 0), np.minimum(at + WIDTH, n)), (np.maximum(at - SIDE, 0), at + GRAM), (at, np.minimum(at + GRAM + SIDE, n))]
                    frag, lft, rgt = around(data, ends)
                    parts[0].append((h >> _S32).astype(np.uint32).view(np.int32))
                    parts[1].append(frag.view(np.int64))
                    parts[2].append(chained(grams, *ends[0]).view(np.int64))
                    parts[3].append((lft >> _S32 << _S32 | rgt >> _S32).view(np.int64))
                    parts[4].append(np.full(len(at), own[0], np.int64))
                    parts[5].append(at)
                    if keyed:
                        parts[6].append(np.full(len(at), own[1], np.int64))
                if parts[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], schema=schema)

    return docs.mapInArrow(run, "anchor int, " + ", ".join(f"{c} long" for c in fields))


_JUDGED = pa.schema([("settled", pa.bool_()), ("uid", pa.int64()), ("pos", pa.int64())])


def _sides_met(anchor: np.ndarray, side: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """For every row 1 if another ord has its (anchor, side) too, and 4 more if over ``MOST_FRAGMENTS`` rows have it."""
    out = np.zeros(len(anchor), np.int64)
    if len(anchor):
        o = np.lexsort((side, anchor))
        a, s, x = anchor[o], side[o], ord_[o]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
        met = np.minimum.reduceat(x, starts) < np.maximum.reduceat(x, starts)
        sizes = np.diff(np.r_[starts, len(a)])
        out[o] = np.repeat(met * (1 + 4 * (sizes > MOST_FRAGMENTS)), sizes)
    return out


def judged(rows: DataFrame) -> DataFrame:
    """Anchors whose fragment is covered whole (settled), and those that a fragment with an equal side may cover in part.

    pos of the latter is 16 times the place, plus 1 if the left side is met elsewhere and 2 if the right one is, plus 4 and 8 if it is met
    so often that it must be split.
    """

    order = tuple(c for c in ("anchor", *_ANCHOR_FIELDS, "uid") if c in rows.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, np.int32)] + [np.empty(0, np.int64)] * (len(order) - 1)
        held = empty  # rows of the open anchor that are not settled
        flooded: int | None = None  # the open anchor, if it has more rows than are held: its held row only stands for its class

        def out(settled: bool, uid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(uid):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), settled)), pa.array(uid), pa.array(pos)], schema=_JUDGED)

        def compared(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            anchor, sides, ord_, pos, uid = x[0], x[3], x[4], x[5], x[-1] if len(x) > 6 else x[4]
            bits = _sides_met(anchor, sides >> 32, ord_) + 2 * _sides_met(anchor, sides & 0xFFFFFFFF, ord_)
            met = bits > 0
            yield from out(False, uid[met], pos[met] * 16 + bits[met])

        for batch in batches:
            cols = [np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held)]
            anchor, frag, frag2, sides, ord_, pos = cols[:6]
            uid = cols[6] if len(cols) > 6 else ord_
            if not len(anchor):
                continue
            stands = np.zeros(len(anchor), bool)
            if flooded is not None:
                stands[0] = True
            fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (frag[1:] != frag[:-1]) | (frag2[1:] != frag2[:-1]) | (sides[1:] != sides[:-1])]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), 0))
            later = ord_ > ord_[first]
            yield from out(True, uid[later], pos[later])
            kept = ~later & ~stands
            open_ = anchor == anchor[-1]
            flood = flooded is not None and anchor == flooded
            if flooded is not None:
                yield from out(False, uid[kept & flood], pos[kept & flood] * 16 + 15)
                kept &= ~flood
            done = kept & ~open_
            yield from compared([c[done] for c in cols])
            stay = kept & open_
            if flooded == int(anchor[-1]) or stay.sum() > MOST_HELD:
                yield from out(False, uid[stay], pos[stay] * 16 + 15)
                flooded = int(anchor[-1])
                stay = np.zeros(len(anchor), bool)
                stay[first[-1]] = True
            else:
                flooded = None
            held = [c[stay].copy() for c in cols]
        if flooded is None:
            yield from compared(held)

    dealt = rows.select(*order).repartition(shuffle_width(rows.sparkSession), "anchor").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "settled boolean, uid long, pos long")


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (uint8, last element 0) in order of at least their first ``depth`` bytes, by two-stage sorting.

    With ``wanted`` (a mask) only those suffixes are sure to be there, with the successors from which they are induced.
    """
    n = len(text)
    # the next byte that differs decides whether a suffix is smaller than its successor
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    run_end = np.full(n, n - 1)
    bounds = np.r_[0, change, n]
    lengths = np.diff(bounds)
    nxt = np.minimum(bounds[1:], n - 1)
    run_end = np.repeat(nxt, lengths)
    smaller = text < text[run_end]
    smaller[text == 0] = True  # separators and the end lie below all that follows
    if wanted is None:
        direct = np.flatnonzero(smaller)
    else:
        # the suffixes sorted directly at or after a wanted one: those in between are induced from them
        at = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
        needed = np.zeros(n, bool)
        needed[at[wanted]] = True
        direct = np.flatnonzero(needed)
    padded = text.tobytes()
    big = words8(padded).byteswap()
    keys = [big[np.minimum(direct + o, n - 1)] * (direct + o < n) for o in range(0, depth, 8)]
    direct = direct[np.lexsort(keys[::-1])]
    bucket = text[direct]
    cuts = np.searchsorted(bucket, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(entries: np.ndarray, c: int) -> np.ndarray:
        """Puts the predecessors that are not sorted directly at the heads of their buckets; those in bucket c are returned."""
        before = entries[entries > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return before
        head = text[before]
        own = before[head == c]
        before, head = before[head != c], head[head != c]
        if len(before):
            o = np.argsort(head, kind="stable")
            before, head = before[o], head[o]
            at = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            for s, e in zip(at, np.r_[at[1:], len(head)]):
                induced[head[s]].append(before[s:e])
        return own

    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, c)
        mine = direct[cuts[c] : cuts[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(order: np.ndarray, text: bytes, cap: int) -> np.ndarray:
    """For each suffix in ``order`` the bytes it shares with the one before it, ``cap`` at most; 0 for the first."""
    w = words8(text)
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for o in range(0, cap, 8):
        ia, ib = a[alive] + o, b[alive] + o
        inside = (ia < len(w)) & (ib < len(w))
        alive, ia, ib = alive[inside], ia[inside], ib[inside]
        diff = w[ia] ^ w[ib]
        apart = diff != 0
        ended, diff = alive[apart], diff[apart]
        # the lowest bit that differs is a power of two, so its logarithm is exact
        low = diff & (~diff + np.uint64(1))
        out[ended + 1] = np.minimum(o + np.log2(low.astype(np.float64)).astype(np.int64) // 8, cap)
        alive = alive[~apart]
        out[alive + 1] = min(o + 8, cap)
    return out


def covered_starts(fragments: list[bytes], ords: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and start of the ``width``-byte strings that a fragment with a smaller ord has too, ordered by both."""
    # bytes are raised by one, so that 0 can separate; 255 does not occur in UTF-8
    text = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8) + np.uint8(1)
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text[ends] = 0
    of = np.repeat(np.arange(len(fragments)), sizes + 1)
    room = ends[of] - np.arange(len(text))
    order = suffix_array(text, width, room >= width)
    order = order[room[order] >= width]
    if not len(order):
        return order, order
    fresh = common_prefixes(order, text.tobytes(), width) < width
    o = ords[of[order]]
    runs = np.flatnonzero(fresh)
    hit = np.sort(order[o > np.repeat(np.minimum.reduceat(o, runs), np.diff(np.r_[runs, len(order)]))])
    return of[hit], hit - starts[of[hit]]


_PIECES = pa.schema([("side", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("ord", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])
_PIECES_SQL = "side long, lo int, hi int, ord long, uid long, start long, at int, bytes binary"
#: A window that holds an anchor has so many bytes before it at most.
_BEFORE = WIDTH - GRAM


def fragments(located: DataFrame, hot: bool) -> DataFrame:
    """located: ord, uid, text, pos (array of anchor positions with sides). A row per anchor and side that is met elsewhere, so often or not.

    lo and hi: the windows that the row stands for have so many bytes before the anchor, which is ``at`` bytes from the fragment's start.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Surroundings()
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                rows: list[tuple] = []
                for ord_, uid, data, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist()):
                    p = np.unique(np.array(pos, np.int64))
                    at, met = p >> 4, p & 3 & ((p >> 2) if hot else ~(p >> 2))
                    start, end = np.maximum(at - _BEFORE, 0), np.minimum(at + WIDTH, len(data))
                    sides = [(np.maximum(at - SIDE, 0), at + GRAM), (at, np.minimum(at + GRAM + SIDE, len(data)))]
                    for keys, bit, lo, hi in zip(around(data, sides), (1, 2), (SIDE, 0), (_BEFORE, SIDE)):
                        on = met & bit > 0
                        rows += [(k, lo, hi, ord_, uid, s, a - s, data[s:e]) for k, s, e, a in zip(keys[on].view(np.int64).tolist(), start[on].tolist(), end[on].tolist(), at[on].tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return located.select("ord", "uid", "text", "pos").mapInArrow(run, _PIECES_SQL)


def halved(pieces: DataFrame) -> DataFrame:
    """Each row as two, for the lower and the upper half of its windows, with a hash of the bytes that all windows of the half hold as side.

    A half of which the fragment has no whole window is left out.
    """
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, lo, hi, ord_, uid, start, at, data in zip(*(batch.column(i).to_pylist() for i in range(8))):
                middle = (lo + hi) // 2
                for a, b in ((lo, middle), (middle + 1, hi)):
                    # windows begin within the fragment and end within it
                    if min(b, at) < max(a, at + WIDTH - len(data)):
                        continue
                    held = data[max(at - a, 0) : at + WIDTH - b]
                    rows.append((xxhash.xxh64_intdigest(held) - (1 << 63), a, b, ord_, uid, start, at, data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return pieces.mapInArrow(run, _PIECES_SQL)


def bounded(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with sides of at most ``most`` rows, unless their windows are one, by halving the windows of the others."""
    rows, out, key = pieces, None, ["side", "lo", "hi"]
    while True:
        hot = written(rows.filter("lo < hi").groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n"))
        if hot.isEmpty():
            return rows if out is None else out.union(rows)
        rows_of = lambda how: rows.join(hot, key, how).select(*_PIECES.names)  # noqa: E731, B023
        cold = rows_of("left_anti")
        out = cold if out is None else out.union(cold)
        rows = written(halved(rows_of("left_semi")))


_COVERED = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def shared(pieces: DataFrame, run_bytes: int = 1 << 20) -> DataFrame:
    """uid, start, end of the strings in ``pieces`` that an earlier document has, by suffix arrays over runs of whole groups.

    Where one window is left its bytes are the group's key; bytes equal to those of the first row, which has the smallest ord, are shared.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, np.int64)] * 6
        held, texts, size = empty, [], 0  # side, lo, hi, ord, uid, start and bytes of the rows that have several windows
        side: tuple | None = None
        least: dict[bytes, int] = {}
        alike: list[tuple[int, int, int]] = []

        def sent(*columns: np.ndarray | tuple) -> Iterator[pa.RecordBatch]:
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_COVERED)

        def solve(upto: int) -> Iterator[pa.RecordBatch]:
            """Sends what the first ``upto`` of the held rows share; groups of one document have nothing to share."""
            key, ord_ = [c[:upto] for c in held[:3]], held[3][:upto]
            bounds = np.r_[np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in key])]), upto]
            used = np.flatnonzero(np.repeat(ord_[bounds[:-1]] != ord_[bounds[1:] - 1], np.diff(bounds)))
            if not len(used):
                return
            owner, at = covered_starts([texts[i] for i in used.tolist()], ord_[used])
            ends = np.flatnonzero(np.r_[(owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1), True]) if len(at) else at
            first = np.r_[0, ends[:-1] + 1][: len(ends)]
            row = used[owner[ends]]
            yield from sent(held[4][row], held[5][row] + at[first], held[5][row] + at[ends] + WIDTH)

        for batch in batches:
            columns = [np.asarray(batch.column(i)).astype(np.int64) for i in range(7)]
            data = batch.column(7).to_pylist()
            alone = np.flatnonzero(columns[1] == columns[2])
            for k, key, lo, hi, ord_, uid, start, at in zip(*(x.tolist() for x in (alone, *(c[alone] for c in columns)))):
                if (key, lo, hi) != side:
                    least.clear()
                    side = (key, lo, hi)
                window = data[k][at - lo : at - lo + WIDTH]
                if least.setdefault(window, ord_) < ord_:
                    alike.append((uid, start + at - lo, start + at - lo + WIDTH))
            yield from sent(*zip(*alike))
            alike.clear()
            if len(alone):
                several = np.flatnonzero(columns[1] < columns[2])
                columns, data = [c[several] for c in columns], [data[k] for k in several.tolist()]
            held = [np.concatenate(x) for x in zip(held, columns)]
            texts += data
            size += sum(map(len, data)) + len(data)
            if size >= run_bytes:
                # the last group may go on in the next batch
                closed = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in held[:3]]))
                if len(closed):
                    upto = int(closed[-1]) + 1
                    yield from solve(upto)
                    held, texts = [c[upto:] for c in held], texts[upto:]
                    size = sum(map(len, texts)) + len(texts)
        if texts:
            yield from solve(len(texts))

    dealt = pieces.repartition(shuffle_width(pieces.sparkSession), "side", "lo", "hi").sortWithinPartitions("side", "lo", "hi", "ord")
    return dealt.mapInArrow(run, "uid long, start long, end long")


def _where(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    few = ids.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "uid", how)


_RESULT = pa.schema([("ord", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def merged_spans(cover: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of each list's spans (struct start, end), joined where they overlap or touch, and where each list's begin."""
    flat = cover.flatten()
    start, end = (np.asarray(flat.field(c)) for c in ("start", "end"))
    of = np.repeat(np.arange(len(cover)), np.asarray(cover.value_lengths()))
    # one line for all lists, each beyond the ends of those before it
    apart = of * (int(end.max(initial=0)) + 2)
    order = np.argsort(start + apart)
    start, end, of, apart = start[order], end[order], of[order], apart[order]
    reach = np.maximum.accumulate(end + apart)
    fresh = np.r_[True, (start + apart)[1:] > reach[:-1]][: len(start)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(start)][: len(first)] - 1
    return start[first].tolist(), (reach - apart)[last].tolist(), np.searchsorted(of[first], np.arange(len(cover) + 1)).tolist()


def remove_spans(located: DataFrame, keep_text: bool = False) -> DataFrame:
    """located: ord, text, cover (array of struct start, end). The digest columns, and the remaining bytes if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            start, end, bounds = merged_spans(batch.column(2))
            for k, (ord_, data) in enumerate(zip(batch.column(0).to_pylist(), _bytes(batch.column(1)))):
                spans = list(zip(start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]))
                at, parts = 0, []
                for s, e in spans:
                    parts.append(data[at:s])
                    at = e
                kept = b"".join([*parts, data[at:]])
                rows.append((ord_, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return located.select("ord", "text", "cover").mapInArrow(run, "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for) of every document."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), whole_text().alias("text"))
    # the doc_id is the row's key, unless rows share it: then each gets a number, which is written with it
    if d.groupBy("ord").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        d = d.withColumn("uid", F.col("ord"))
        fields = ("ord", "text")
    else:
        d = written(d.withColumn("uid", F.monotonically_increasing_id()))
        fields = ("ord", "text", "uid")
    size = F.octet_length("text").cast("long")
    keys = written(d.select("ord", "uid", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), size.alias("n_bytes")))
    # 1. copies of whole texts: all but those with the smallest id of each
    low = keys.filter(F.col("n_bytes") >= WIDTH).groupBy("k1", "k2", "n_bytes").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).filter("least < most")
    copies = written(keys.join(low.drop("most"), ["k1", "k2", "n_bytes"]).filter("ord > least").select("ord", "uid", "n_bytes"))
    firsts = _where(d, copies.select("uid"), "left_anti").select("ord", "uid", "text")
    # 2. anchors, and what their surroundings settle
    found = written(judged(anchor_rows(firsts.select(*fields))))
    # 3. suffix arrays over what is left
    open_ = written(found.filter("NOT settled").groupBy("uid").agg(F.collect_list("pos").alias("pos")))
    located = _where(firsts, open_.select("uid"), "left_semi").join(open_, "uid")
    pieces = fragments(located, False)
    if not found.filter("NOT settled AND pos & 12 != 0").isEmpty():
        pieces = pieces.union(bounded(written(fragments(located, True)), MOST_FRAGMENTS))
    near = written(shared(pieces).distinct())
    whole = found.filter("settled").select("uid", F.greatest(F.col("pos") - _BEFORE, F.lit(0)).cast("long").alias("start"), (F.col("pos") + WIDTH).alias("end"))
    cover = whole.union(near).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("cover"))
    touched = written(cover)
    cut = remove_spans(_where(firsts, touched.select("uid"), "left_semi").join(touched, "uid"), keep_text)
    text_bytes = F.encode("text", "UTF-8")
    plain = _where(firsts, touched.select("uid"), "left_anti").select(
        "ord", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text_bytes, 256).alias("kept_sha256"), (text_bytes if keep_text else F.lit(None).cast("binary")).alias("kept")
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    copied = copies.select("ord", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), F.lit(b"" if keep_text else None).cast("binary").alias("kept"))
    out = cut.union(plain).union(copied)
    return out.select(F.when(F.col("ord") != _LAST, F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
