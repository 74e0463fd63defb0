"""Near duplicates by a grouped prefix join over word n-grams.

A document's set holds the hashes of its distinct five-word shingles. Under the order of the hashes, two sets that are alike to 0.8
share at least :func:`least_common` of their first :func:`prefix_length` elements. Sets with identical prefixes and size form one
group, and groups, not sets, are joined:

1. every text is shingled once into a table of its set's size, two hashes that name the set (128 bits), a hash of prefix and size that
   names the group, and the prefix. Equal sets are one member, whatever the number of documents that have them. (Two prefixes under one
   group hash would only add candidates, as every member is verified.)
2. the groups' prefix elements are dealt out by element and sorted by size; an element in few groups (``bucket``) gives all pairs of
   groups whose sizes allow a link;
3. an element in more groups gives none yet. A group whose prefix holds too few such elements to reach ``least_common`` through
   them alone is done with: each of its links also shares a rare element. For the others each element links neighbours in order
   of size and the first with all, which ties groups of near copies together with a linear number of candidates;
4. group pairs that pass are expanded to their members and verified on whole texts, as are the members of one group. Where groups are too
   large for all pairs (``members``), neighbours are verified and the rest goes the way of 5;
5. links become components; members of different components that share a frequent element, a large group or a pair of groups with a
   large one then meet in blocks, where an inverted index counts what they share (:func:`within_blocks`). So no link between components is
   lost, and no pairs are listed within one.

Nothing is capped: ``bucket`` and ``members`` decide which of two exact ways an element or a group goes. Links within a component are not
all listed, so there is no number of links by document.

Defined results: null text is empty; without words the set is empty and linked with nothing; with fewer than five words the whole
sequence is the one shingle; a text of any length is read whole; repeated rows and rows that share a doc_id are members each; rows with
a null doc_id are linked like others and never the smallest (a class of such rows alone has a null component_id); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, arrow_rows, checkpointed, settled, shuffle_width, written
from .components import components

#: Ids up to this number are broadcast as a filter; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Shingler:
    """Texts (UTF-8 bytes) to sorted arrays of distinct shingle hashes."""

    def __init__(self, width: int = SHINGLE_WORDS, most_words: int = 200_000):
        import xxhash

        digest = xxhash.xxh64_intdigest

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                value = self[word] = digest(word)
                return value

        self.words, self.width, self.most_words = Words(), width, most_words

    def __call__(self, text: bytes) -> np.ndarray:
        # bytes.lower() lower-cases A-Z alone and bytes.split() splits at \x20 and \x09-\x0D alone
        w = text.lower().split()
        if len(self.words) > self.most_words:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, w), np.uint64, len(w))
        if not len(w):
            return h
        with np.errstate(over="ignore"):
            width = min(self.width, len(w))
            n = len(w) - width + 1
            g = np.full(n, np.uint64(width))
            for j in range(width):
                g = g * _MULTIPLIER + h[j : j + n]
                g ^= g >> np.uint64(29)
            g = (g ^ (g >> np.uint64(30))) * _MIX_A
            g = (g ^ (g >> np.uint64(27))) * _MIX_B
            return np.unique(g ^ (g >> np.uint64(31)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return _signed(both >> 64), _signed(both & (1 << 64) - 1)


def group_key(prefix: np.ndarray, n: int) -> int:
    import xxhash

    return _signed(xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n & 0xFFFFFFFF))


def prefix_length(n: int) -> int:
    """A fifth of the set, which any link must touch, and a tenth more, for :func:`least_common` to grow with the set."""
    return min(n, n - (4 * n + 4) // 5 + 1 + n // 10) if n else 0


def least_common(na: Column, nb: Column) -> Column:
    """Prefix elements that two sets of these sizes share at least if they are alike to 0.8."""

    def of(n: Column, both: Column) -> Column:
        prefix = F.least(n, n - F.floor((4 * n + 4) / 5) + 1 + F.floor(n / 10))
        return prefix - n + F.ceil(4 * both / 9)

    return F.least(of(na, na + nb), of(nb, na + nb))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("g", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (its name), g (its group), prefix (null where the task has given the group's before)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(), set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                s = shingles(text)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, 0, None))
                    continue
                prefix = s[: prefix_length(len(s))]
                g = group_key(prefix, len(s))
                rows.append((doc_id, len(s), *set_key(s), g, None if g in seen else prefix.view(np.int64)))
                seen.add(g)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS)], schema=_SETS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, g long, prefix array<long>")


_BUCKETS = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("na", pa.int64()), ("b", pa.int64()), ("nb", pa.int64())])


def buckets(rows: DataFrame, bucket: int = 16) -> DataFrame:
    """From prefix rows: (a, na, b, nb) for pairs under rare elements, (token, a, na) for the rows of frequent ones."""
    def pairs(token: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[], [], [], []]
        for d in range(1, bucket):
            if d >= len(token):
                break
            ok = (token[d:] == token[:-d]) & (5 * n[:-d] >= 4 * n[d:])
            if not (token[d:] == token[:-d]).any():
                break
            i = np.flatnonzero(ok)
            for out, x in zip(found, (key[i], n[i], key[i + d], n[i + d])):
                out.append(x)
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]

    def batch_of(hot: tuple[np.ndarray, ...] | None, paired: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if hot is not None and len(hot[0]):
            m = len(hot[0])
            yield pa.RecordBatch.from_arrays([pa.array(hot[0]), pa.array(hot[1]), pa.array(hot[2]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=_BUCKETS)
        if paired is not None and len(paired[0]):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(paired[0]), pa.int64()), *[pa.array(x) for x in paired]], schema=_BUCKETS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        frequent: int | None = None  # an element that has shown itself frequent and may go on
        last: tuple[int, int] | None = None
        for batch in batches:
            token, key, n = (np.asarray(batch.column(i)) for i in range(3))
            # the same set from several tasks stands in adjacent rows
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            if len(token) and last == (int(token[0]), int(key[0])):
                fresh[0] = False
            if len(token):
                last = (int(token[-1]), int(key[-1]))
            token, key, n = (np.concatenate([h, x[fresh]]) for h, x in zip(held, (token, key, n)))
            if not len(token):
                continue
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            over = sizes > bucket
            if frequent is not None:
                over[0] = over[0] or token[0] == frequent
            # the last element may go on in the next batch
            tail = starts[-1]
            open_is_frequent = bool(over[-1])
            frequent = int(token[-1]) if open_is_frequent else None
            done = len(token) if open_is_frequent else tail
            hot = np.repeat(over, sizes)[:done]
            held = [x[done:].copy() for x in (token, key, n)]
            token, key, n = token[:done], key[:done], n[:done]
            yield from batch_of((token[hot], key[hot], n[hot]), pairs(token[~hot], key[~hot], n[~hot]))
        token, key, n = held
        yield from batch_of(None, pairs(token, key, n))

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "token").sortWithinPartitions("token", "n", "key")
    return dealt.mapInArrow(run, "token long, a long, na long, b long, nb long")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id, by broadcast while the ids are few."""
    few = ids.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def keyed_texts(docs: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """key, text (one whole text of each set in ``keys``). sets: key, k1, k2, rep (a doc_id with that set, null if none has one)."""
    needed = settled(keys.join(sets, "key").select("key", "k1", "k2", F.col("rep").alias("doc_id")))
    texts = _only(docs.select(F.col("doc_id").cast("long"), "text"), needed.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "left_semi")
    if not needed.filter("doc_id IS NULL").isEmpty():
        texts = texts.union(docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long"), "text"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            raw = _texts(batch, 0)
            names = [set_key(s) if len(s := shingles(t)) else (0, 0) for t in raw]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in names], pa.int64()), pa.array([k[1] for k in names], pa.int64()), pa.array(raw, pa.binary())], names=["k1", "k2", "text"])

    # keyed by the set itself, so that rows which share a doc_id do no harm
    side = needed.select("key", "k1", "k2")
    few = needed.count() <= MOST_BROADCAST_IDS
    found = texts.select("text").mapInArrow(keyed, "k1 long, k2 long, text binary").join(F.broadcast(side) if few else side, ["k1", "k2"])
    return found.select("key", "text").dropDuplicates(["key"])


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets, made again from whole texts, are alike to 0.8."""
    texts = keyed_texts(docs, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        key, tokens = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != key:
                    key, tokens = a, shingles(ta)
                other = shingles(tb)
                common = len(np.intersect1d(tokens, other, assume_unique=True))
                if 100 * common >= 80 * (len(tokens) + len(other) - common):
                    keep.append((a, b))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*keep)], schema=_LINKS)

    sa = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    sb = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(sb, "b").join(sa, "a").select("a", "b", "ta", "tb")
    with arrow_rows(docs.sparkSession, 200):
        return settled(both.mapInArrow(run, "a long, b long"))


def block_links(keys: list[int], sets: list[np.ndarray], roots: list[int], chunks: list[int], search: np.ndarray) -> list[tuple[int, int]]:
    """Links between members with different roots, as few as join what they join; members in ``search`` are tried on all others.

    ``chunks`` splits a large block: two members meet only if they are of the two chunks of this task, or it has just one.
    """
    m = len(keys)
    size = np.array([len(x) for x in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(m), size)
    order = np.argsort(local, kind="stable")
    postings = member[order]
    count = np.bincount(local)
    at = np.r_[0, np.cumsum(count)]
    first = np.r_[0, np.cumsum(size)]
    root, chunk = np.array(roots), np.array(chunks)
    several = len(set(chunks)) > 1
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for i in search.tolist():
        ids = local[first[i] : first[i + 1]]
        ids = ids[count[ids] > 1]
        lens = count[ids]
        where = np.repeat(at[ids] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum()) if len(ids) else ids
        common = np.bincount(postings[where], minlength=m)
        alike = (100 * common >= 80 * (size[i] + size - common)) & (root != root[i])
        if several:
            alike &= chunk != chunk[i]
        for j in np.flatnonzero(alike).tolist():
            ri, rj = find(roots[i]), find(roots[j])
            if ri != rj:
                parent[ri] = rj
                out.append((keys[i], keys[j]))
    return out


def within_blocks(docs: DataFrame, rows: DataFrame, roots: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between components among the members of each block. rows: label, key.

    Blocks of more than ``block`` sets are cut into chunks, and every two chunks meet in a task of their own; a task never holds more
    than two chunks. Sets outside a block's largest component are tried on all others.
    """
    rows = settled(rows.distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("label", "key", F.coalesce("root", "key").alias("root")))
    per = rows.groupBy("label", "root").agg(F.count("*").alias("m")).groupBy("label").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"), F.sum("m").alias("m"))
    per = per.filter("roots > 1").select("label", F.col("top.root").alias("top"), F.ceil(F.col("m") / block).cast("int").alias("n_chunks"))
    rows = rows.join(per, "label").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("n_chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    rows = rows.select("label", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "key", "root", (F.col("root") != F.col("top")).alias("stray"))
    rows = checkpointed(rows)
    texts = keyed_texts(docs, rows.select("key").distinct(), sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        now, members = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if not members:
                return
            keys, roots_, chunks, strays, sets = (list(x) for x in zip(*members))
            found = block_links(keys, sets, roots_, chunks, np.flatnonzero(strays))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=_LINKS)

        for batch in batches:
            for label_, x, y, chunk, key, root, stray, text in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (label_, x, y) != now:
                    yield from solve()
                    now, members = (label_, x, y), []
                members.append((key, root, chunk, stray, shingles(text)))
        yield from solve()

    dealt = rows.join(texts, "key").select("label", "x", "y", "chunk", "key", "root", "stray", "text").repartition(shuffle_width(docs.sparkSession), "label", "x", "y").sortWithinPartitions("label", "x", "y", "key")
    with arrow_rows(docs.sparkSession, 200):
        return settled(dealt.mapInArrow(run, "a long, b long"))


def _classes(docs: DataFrame, bucket: int, block: int, members: int) -> tuple[DataFrame, DataFrame]:
    """(the table of :func:`document_sets`, sets with the class each belongs to: k1, k2, root, component_id)."""
    with arrow_rows(docs.sparkSession, 500):
        base = written(document_sets(docs))
    some = base.filter("n > 0")
    named = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("g").alias("g"))
    sets = checkpointed(named.withColumn("key", F.monotonically_increasing_id()))
    found = checkpointed(buckets(some.filter(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("token"), F.col("g").alias("key"), "n"), bucket))

    # prefix elements under frequent tokens, by group
    hot = found.filter(F.col("token").isNotNull()).select("token", F.col("a").alias("g"), F.col("na").alias("n"))
    per_group = hot.groupBy("g", "n").agg(F.count("*").alias("h"))
    strong = settled(per_group.filter(F.col("h") + 2 >= F.col("n") / 10).select("g", "h"))
    hot = settled(hot.join(strong, "g"))

    cold = found.filter(F.col("token").isNull()).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
    ha = per_group.select(F.col("g").alias("a"), F.col("h").alias("ha"))
    hb = per_group.select(F.col("g").alias("b"), F.col("h").alias("hb"))
    cold = cold.join(ha, "a", "left").join(hb, "b", "left")
    reach = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    cold = cold.filter(reach >= least_common(F.col("na"), F.col("nb"))).select("a", "b")

    by = Window.partitionBy("token").orderBy("n", "g")
    along = hot.select("g", "n", F.lag("g").over(by).alias("g1"), F.lag("n").over(by).alias("n1"), F.first("g").over(by).alias("g0"), F.first("n").over(by).alias("n0"))
    fits = lambda m: (5 * F.col(m) >= 4 * F.col("n")) & (5 * F.col("n") >= 4 * F.col(m))
    chain = along.filter(F.col("g1").isNotNull() & fits("n1")).select(F.col("g1").alias("a"), F.col("g").alias("b"))
    star = along.filter((F.col("g0") != F.col("g")) & fits("n0")).select(F.col("g0").alias("a"), F.col("g").alias("b"))
    ordered = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()

    # expansion to members: all pairs where there are few, neighbours and a block where there are many
    group = checkpointed(sets.groupBy("g").agg(F.count("*").alias("m"), F.min("key").alias("one")))
    of = sets.select("g", "key")
    side = lambda d, x: d.join(group.select(F.col("g").alias(x), F.col("m").alias(f"m{x}"), F.col("one").alias(f"one{x}")), x)
    expand = lambda d: d.join(of.select(F.col("g").alias("a"), F.col("key").alias("ka")), "a").join(of.select(F.col("g").alias("b"), F.col("key").alias("kb")), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    cold = checkpointed(side(side(ordered(cold), "a"), "b"))
    small = (F.col("ma") <= members) & (F.col("mb") <= members)
    ones = lambda d: d.select(F.col("onea").alias("a"), F.col("oneb").alias("b"))
    tied = ones(side(side(ordered(chain.union(star)), "a"), "b"))
    several = sets.select("g", "key").join(group.filter("m > 1").select("g", "m"), "g")
    inner = several.filter(F.col("m") <= members).select("g", F.col("key").alias("a")).join(several.select("g", F.col("key").alias("b")), "g").filter("a < b").select("a", "b")
    many = checkpointed(several.filter(F.col("m") > members).select("g", "key"))
    along = many.withColumn("before", F.lag("key").over(Window.partitionBy("g", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key"))).join(group.select("g", "one"), "g")
    inner = inner.union(along.select("one", "key")).union(along.filter("before IS NOT NULL").select("before", "key"))
    first_pairs = settled(ordered(expand(cold.filter(small)).union(ones(cold.filter(~small))).union(tied).union(inner)))
    links = verified(docs, first_pairs, sets)
    roots = settled(components(links))

    # elements are gathered into blocks by the set, of those under them, with the most frequent elements, so most elements of a family
    # of copies make one block and each set is sent to a few blocks only
    label = hot.groupBy("token").agg(F.max(F.struct("h", "g")).alias("m")).select("token", F.col("m.g").alias("label"))
    blocks = hot.join(label, "token").select("label", "g").distinct()
    wide = cold.filter(~small).select(F.xxhash64("a", "b").alias("label"), F.explode(F.array("a", "b")).alias("g"))
    blocks = blocks.union(wide).join(of, "g").select("label", "key").union(many.select(F.xxhash64("g").alias("label"), "key"))
    more = within_blocks(docs, blocks, roots, sets, block)
    if not more.isEmpty():
        roots = settled(components(links.union(more)))

    classes = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("k1", "k2", "rep", F.coalesce("root", "key").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return base, checkpointed(classes.join(least, "root").select("k1", "k2", "root", "component_id"))


def near_duplicates(docs: DataFrame, bucket: int = 16, block: int = 2000, members: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    base, classes = _classes(docs, bucket, block, members)
    out = base.filter("n > 0").select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(base.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, bucket: int = 16) -> DataFrame:
    """One row of every class, that with the smallest doc_id (of equal ones any), and every row without words; with their own columns."""
    base, classes = _classes(docs, bucket, 2000, 8)
    member = base.filter("n > 0").select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "component_id")
    counted = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c"))
    unsure = checkpointed(counted.filter("c > 1").select("doc_id"))
    gone = member.filter("doc_id != component_id").select("doc_id").distinct()
    if unsure.isEmpty() and base.filter("doc_id IS NULL").isEmpty():
        return _only(docs, checkpointed(gone), "left_anti").select(docs.columns)
    # rows whose doc_id does not name them are told apart by their sets
    sure = _only(_only(docs.filter("doc_id IS NOT NULL"), checkpointed(gone.join(unsure, "doc_id", "left_anti")), "left_anti"), unsure, "left_anti").select(docs.columns)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    ids = docs["doc_id"].cast("long").alias("doc_id")
    rows = docs.select(ids, docs["text"].alias("text"), row)
    rows = rows.join(unsure, "doc_id", "left_semi").union(rows.filter("doc_id IS NULL"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            names = [set_key(s) if len(s := shingles(t)) else (None, None) for t in _texts(batch, 1)]
            k = [pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *k, batch.column(2)], names=["doc_id", "k1", "k2", "row"])

    none = F.lit(None).cast("long")
    schema = rows.select("doc_id", none.alias("k1"), none.alias("k2"), "row").schema
    rows = checkpointed(rows.mapInArrow(keyed, schema))
    empty = rows.filter("k1 IS NULL").select("row.*")
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2")
    rest = rows.join(classes, ["k1", "k2"]).filter("component_id IS NULL OR doc_id = component_id").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return sure.union(rest.select("row.*")).union(empty)
