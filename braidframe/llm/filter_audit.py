"""How document filters interact: what each removes in every order, what is redundant, and whom it costs good or toxic documents.

Five filters A to E give every document a mask of the filters that it fails. A precomputed table of 32 masks by 120 orders has the
step at which an order removes a document with that mask first; a task looks up all orders of its documents at once and counts
removals by part, order and step with ``np.bincount``, once for all documents and once for each label. What leaves a task are these
counts, 600 for a part at most, which Spark adds up; so neither hot sources nor hot texts are gathered anywhere.

Filter E asks for an equal text with a smaller doc_id anywhere. Texts are equal if their SHA-256 is; the smallest doc_id of each hash
that occurs more than once is joined back to the narrow rows, a join whose hot keys Spark may split.

Defined results: null text is empty, null source the empty part; a null doc_id comes after all others and null ones do not remove
each other; rows that share a doc_id and a text are judged alike, and neither removes the other; texts of any length are read whole;
of several labels of one doc_id, 1 wins, and labels without a doc_id count for nobody; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SYMBOLS, _CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUATIONS = bytes(range(0x80, 0xC0))

ORDERS: list[str] = ["".join(p) for p in permutations(FILTERS)]
NEVER = len(FILTERS)


def first_failures() -> np.ndarray:
    """32 masks by 120 orders: the step (from 0) at which an order removes a document with the mask, ``NEVER`` for the mask 0."""
    masks = np.arange(1 << len(FILTERS))
    out = np.full((len(masks), len(ORDERS)), NEVER, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(len(order))):
            out[masks >> FILTERS.index(order[step]) & 1 == 1, o] = step
    return out


def own_failures(data: bytes) -> int:
    """The bits of filters A to D, which need no other text. ``bytes.split`` splits at the six ASCII white-space bytes."""
    words = data.split()
    n = len(words)
    points = len(data) - (0 if data.isascii() else len(data) - len(data.translate(None, _CONTINUATIONS)))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    few = n < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * n
    loud = 100 * capitals > MOST_CAPITALS * points
    symbols = len(data.translate(None, _SYMBOLS)) < len(data)
    return few | repeated << 1 | loud << 2 | symbols << 3


_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("text_key", pa.binary())])


def own_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (filters A to D as bits), text_key of every document, in one pass over the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            bits, keys = [], []
            for x in texts:
                data = x.as_py() or b""
                bits.append(own_failures(data))
                keys.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(keys, pa.binary())], schema=_READ)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return d.mapInArrow(run, "doc_id long, part string, failed int, text_key binary")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (all filters as bits, A lowest) of every document."""
    d = written(own_masks(docs))
    # written, so that the join's sides are shuffles of their own and Spark can split a hot text's rows
    firsts = written(d.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    d = d.join(firsts, "text_key", "left")
    return d.select("doc_id", "part", (F.col("failed") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with good and toxic, false where no label says so."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    by_id = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return failed.join(by_id, "doc_id", "left").fillna(False, ["good", "toxic"])


#: Parts that a task holds counts of before it sends them on.
PARTS_HELD = 1000
_COUNTS = ("docs", "removed", "failing", "unique_fails", "good_lost", "toxic_lost")
_PARTIAL = pa.schema([("part", pa.string()), ("order_no", pa.int32()), ("step", pa.int32()), *[(c, pa.int64()) for c in _COUNTS]])


def removals(marked: DataFrame) -> DataFrame:
    """marked: part, failed, good, toxic. Partial counts by part, order_no and step, to be added up."""
    orders, steps = len(ORDERS), len(FILTERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures()
        # the filter of every order and step, and the masks that fail it, or it alone
        letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
        fails = np.array([[m >> f & 1 for m in range(1 << steps)] for f in range(steps)])
        alone = np.array([[m == 1 << f for m in range(1 << steps)] for f in range(steps)]).astype(np.int64)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def counted(code: np.ndarray, mask: np.ndarray, parts: int) -> np.ndarray:
            at = (code[:, None] * orders + np.arange(orders)) * (steps + 1) + table[mask]
            return np.bincount(at.ravel(), minlength=parts * orders * (steps + 1)).reshape(parts, orders, steps + 1)[:, :, :steps]

        def sent() -> Iterator[pa.RecordBatch]:
            for part, (masks, lost) in held.items():
                columns = (np.full((orders, steps), masks.sum()), lost[0], (fails @ masks)[letters], (alone @ masks)[letters], lost[1], lost[2])
                at = (np.repeat(np.arange(orders, dtype=np.int32), steps), np.tile(np.arange(steps, dtype=np.int32), orders))
                yield pa.RecordBatch.from_arrays([pa.array([part] * (orders * steps)), *map(pa.array, at), *[pa.array(c.ravel()) for c in columns]], schema=_PARTIAL)
            held.clear()

        for whole in batches:
            for batch in (whole.slice(i, 8192) for i in range(0, whole.num_rows, 8192)):
                coded = batch.column(0).dictionary_encode()
                names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
                mask = np.asarray(batch.column(1)).astype(np.int64)
                of = [np.ones(len(mask), bool), *[np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3)]]
                lost = np.stack([counted(code[x], mask[x], len(names)) for x in of], 1)
                masks = np.bincount(code * (1 << steps) + mask, minlength=len(names) << steps).reshape(len(names), -1)
                for k, part in enumerate(names):
                    before = held.get(part)
                    held[part] = (masks[k], lost[k]) if before is None else (before[0] + masks[k], before[1] + lost[k])
                if len(held) > PARTS_HELD:
                    yield from sent()
        yield from sent()

    return marked.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, order_no int, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def audited(marked: DataFrame) -> DataFrame:
    """One row per part, filter_order and step (from 1) of ``marked`` (part, failed, good, toxic)."""
    c = removals(marked).groupBy("part", "order_no", "step").agg(*[F.sum(x).alias(x) for x in _COUNTS])
    name = F.element_at(F.lit(ORDERS), F.col("order_no") + 1)
    c = c.withColumn("filter_order", name).withColumn("filter", F.substring(name, F.col("step") + 1, F.lit(1)))
    so_far = F.sum("removed").over(Window.partitionBy("part", "order_no").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("kept", F.col("docs") - so_far).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return c.select(
        "part", "filter_order", (F.col("step") + 1).alias("step"), "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic)."""
    return audited(labelled(failures(docs), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
m AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(first_id IS NOT NULL AND (doc_id IS NULL OR doc_id > first_id), FALSE) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p, k q, k r, k s, k t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS filter FROM o, range(1, 6) r(step)),
h AS (SELECT part, good, toxic, n, f, x AS filter, CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS fails,
  f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS n_fails FROM g, k),
z AS (SELECT part, good, toxic, n, n_fails, fails, st.*,
    bool_or(fails) OVER (PARTITION BY part, good, toxic, f, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM h JOIN st USING (filter)),
s AS (SELECT part, filter_order, step, filter,
  sum(CASE WHEN fails AND NOT coalesce(gone, FALSE) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN NOT fails AND NOT coalesce(gone, FALSE) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN fails AND coalesce(gone, FALSE) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT coalesce(gone, FALSE) AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN fails AND NOT coalesce(gone, FALSE) AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM s
"""
