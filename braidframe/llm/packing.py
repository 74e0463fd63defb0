"""Cost-balanced packing of token ids into sequences.

Documents become token ids with an end id, full sequences are cut off them, and what is left of each is packed: a piece costs
``linear * n + quadratic * n * n`` (attention within the piece), and pieces, longest first, go to the cheapest sequence with room
for them. There are as many sequences as the tokens need, so the last pieces find no room that is whole; those are cut over the
cheapest sequences with any room. A block of documents thus pads less than one sequence.

Blocks are bounded (``block_tokens``), lie within one input partition and depend on it alone, so a lost executor's partition comes
out the same again; nothing is shuffled. Ids come from the ``tokenizers`` library; texts of printable ASCII and accented Latin
letters, for which the ``tiktoken`` form of the same vocabulary gives the same ids, go through that, which is faster.

Defined results: null text is empty, and an empty text is the end id alone; a text of any length is encoded whole, full sequences are
cut off it and a block is closed behind it; repeated rows are packed each; ties of length keep their input order; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])


@dataclass(frozen=True)
class Packing:
    """Parameters: the tokenizer files, the sequence length, the end id, the cost's weights and the tokens of a block."""

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None
    length: int = 1024
    end_id: int = 0
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    block_tokens: int = 4_000_000


def public_packing() -> Packing:
    import public_tokenizers as public

    return Packing(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


class Encoder:
    """Texts to ids, by the ``tokenizers`` file or by its ``tiktoken`` twin where both agree."""

    def __init__(self, p: Packing):
        import base64
        import re

        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(p.tokenizer)
        self.twin = None
        if p.ranks and p.pattern:
            import tiktoken

            with open(p.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.twin = tiktoken.Encoding("twin", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
        self.unsure = re.compile("[^\n\t\x20-\x7e¡-ſ]|<\\|").search

    def __call__(self, text: str) -> list[int]:
        if self.twin is not None and not self.unsure(text):
            return self.twin.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


class Rooms:
    """Sequences by room left, the cheapest of those with enough of it in a time that does not depend on their number.

    A heap of (cost, sequence) stands at every size of room, and a tree over the sizes holds the least head of each range of them.
    """

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(room + 1)]
        self.heads: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def _head_of(self, room: int) -> None:
        heap, k = self.heaps[room], self.size + room
        self.heads[k] = (*heap[0], room) if heap else None
        while k > 1:
            k //= 2
            x, y = self.heads[2 * k], self.heads[2 * k + 1]
            self.heads[k] = x if y is None or (x is not None and x < y) else y

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._head_of(room)

    def fill(self, count: int, room: int) -> None:
        self.heaps[room] = [(0.0, s) for s in range(count)]
        self._head_of(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with at least ``least`` room, which is taken out; None if there is none."""
        best = None
        lo, hi = self.size + least, 2 * self.size
        while lo < hi:
            for k in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                x = self.heads[k]
                if x is not None and (best is None or x < best):
                    best = x
            lo, hi = (lo + 1) // 2, hi // 2
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._head_of(best[2])
        return best


def balanced(lengths: list[int], room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in item, length, sequence) of items shorter than ``room``; sequences from 0, as few as the total needs.

    An item is cut only when no sequence at all has room for it, over the cheapest ones with any.
    """
    rooms = Rooms(room)
    rooms.fill(-(-sum(lengths) // room), room)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, n = 0, lengths[item]
        while n:
            cost, s, left = rooms.take(n) or rooms.take(1)
            k = min(n, left)
            out.append((item, start, k, s))
            if left > k:
                rooms.put(cost + linear * k + quadratic * k * k, s, left - k)
            start, n = start + k, n - k
    return out


def pack_block(docs: list[tuple[int | None, np.ndarray]], p: Packing, first: int) -> tuple[list[tuple[int | None, int, int, int, int, int, int]], int]:
    """Rows of the result for one block, and the next free sequence id."""
    rows, rest = [], []
    sequence = first

    def row(doc: int, start: int, n: int, s: int, offset: int) -> None:
        key, ids = docs[doc]
        rows.append((key, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), s, offset))

    for d, (_, ids) in enumerate(docs):
        full = len(ids) // p.length
        for k in range(full):
            row(d, k * p.length, p.length, sequence, 0)
            sequence += 1
        if len(ids) % p.length:
            rest.append((d, full * p.length, len(ids) % p.length))
    used: dict[int, int] = {}
    for item, start, n, s in balanced([x[2] for x in rest], p.length, p.linear, p.quadratic):
        d, base, _ = rest[item]
        row(d, base + start, n, sequence + s, used.get(s, 0))
        used[s] = used.get(s, 0) + n
    return rows, sequence + len(used)


def packed(docs: DataFrame, p: Packing | None = None) -> DataFrame:
    """One row per piece of a document."""
    p = p or public_packing()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(p)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        block: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, block, tokens
            rows, sequence = pack_block(block, p, sequence)
            block, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(p.end_id)
                block.append((key, np.array(ids, "<u4")))
                tokens += len(ids)
                if tokens >= p.block_tokens:
                    yield flush()
        if block:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
