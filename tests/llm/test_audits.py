"""Source divergence, filter interaction and SimHash against SQL and brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest
import xxhash

from braidframe.llm import divergence, filter_audit, simhash

from .data import clashing, documents, frame, prose
from .test_ops import WS, as_rows

NAMES = ("term", "lang", "source", "n", "docs", "total", "counts", "sources", "item", "value", "part", "failed", "good", "toxic", "text_key", "first_id", "fp", "y", "path", "root", "node", "rank", "order_no", "step")


def sql(tables, text):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        columns = [c.split() for c in schema.split(", ")]
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {dict(long='BIGINT', int='INTEGER', string='VARCHAR')[t]}' for c, t in columns)})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    cur = con.execute(text)
    names = [x[0] for x in cur.description]
    return sorted((tuple(zip(sorted(names), [r[names.index(c)] for c in sorted(names)])) for r in cur.fetchall()), key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crowded(df):
    from pyspark.sql import functions as F

    df = clashing(df)
    for c in NAMES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("other"))
    return df


# --- source divergence


def spoken(seed=3, n=260):
    """Documents in which many terms reach 30 documents, in languages with several sources, one source, and too few documents."""
    r = random.Random(seed)
    words = [prose(r, 1) for _ in range(120)] + ["été", "Straße", "世界", "a" * 300, "e", "eb", "Eb", "\U0001f600x"]
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["s1", "s1", "s1", "S0", "é", None, ""])
        at = r.randrange(60)
        text = r.choice([" ", "1", "-"]).join(r.choice(words[at:] if source == "s1" else words) for _ in range(r.randint(0, 90)))
        rows.append((i, r.choice([text, text, text, None]) if i % 9 == 0 else text, lang, source, 1))
    rows += [(n, "one two", "fr", "a", 1), (n + 1, None, "fr", "b", 1), (n + 2, "!!", "fr", None, 1), (n + 3, "alone", "it", "a", 1)]
    return rows + rows[:40]  # repeated rows are documents of their own


def test_divergence_equals_sql(spark):
    rows = spoken()
    want = sql({"documents": (rows, DOCS)}, divergence.ORACLE)
    d = frame(spark, rows).repartition(5)
    assert as_rows(divergence.audited(d)) == want
    got = divergence.audited(crowded(d).drop("n_chars"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and as_rows(got) == want
    assert {(dict(x)["lang"], dict(x)["value"]) for x in want if dict(x)["lang"] in ("fr", "it")} == {("fr", 0)}


def test_divergence_with_tries_sent_on_early(spark, monkeypatch):
    """A trie that is sent on after a few counters, at every stage, gives the same counts."""
    rows = spoken(4, 150)
    d = frame(spark, rows).repartition(3)
    want = {(r.lang, bytes(r.term)): {s: n for s, n in zip(r.sources, r.counts)} for r in divergence.merged(divergence.counted(d)).collect()}
    few = divergence.merged(divergence.counted(d, 20, 3), most=10)
    assert {(r.lang, bytes(r.term)): dict(zip(r.sources, r.counts)) for r in few.collect()} == want and want
    monkeypatch.setattr(divergence, "MOST_SOURCES_HELD", 1)
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 3)
    leaves, groups = divergence.merged(divergence.counted(d)).cache(), {"en": (["", "S0", "s1", "é"], np.array([10, 20, 30, 40]), 5), "de": (["", "S0", "s1", "é"], np.array([1, 2, 3, 4]), 5), "": (["", "S0", "s1", "é"], np.array([1, 2, 3, 4]), 5)}

    def total(df):
        out = Counter()
        for r in df.filter("part = 'pair'").collect():
            out[r.lang, r.source, bytes(r.item)] += r.value
        return out

    wide = total(divergence.streamed(leaves, groups))
    monkeypatch.setattr(divergence, "MOST_SOURCES_HELD", 1500)
    assert wide == total(divergence.streamed(leaves, groups))


def test_divergence_of_little(spark):
    assert divergence.audited(frame(spark, [])).count() == 0
    one = divergence.audited(frame(spark, [(None, None, None, None, None)] * 2))
    assert one.count() == 0
    long = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60000))
    rows = [(i, long, "en", "ab"[i % 2], 1) for i in range(30)] + [(40, "aaa", "en", "b", 1)]
    out = divergence.audited(frame(spark, rows)).collect()
    assert len([r for r in out if r.part == "term" and r.source == "a"]) == 50 and len([r for r in out if r.part == "pair"]) == 2


def test_tries_against_a_dict():
    """Tries merged from parts, cut into blocks and merged again from the blocks."""
    r = random.Random(9)
    want, parts = defaultdict(lambda: [0, 0]), []
    for _ in range(6):
        own = defaultdict(lambda: [0, 0])
        for _ in range(300):
            key = (bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randint(0, 5))), r.randrange(3))
            for x in (own, want):
                x[key][0] += 3
                x[key][1] += 1
        terms = list({t for t, _ in own})
        r.shuffle(terms)
        parts.append((terms, *(np.array(x, np.int64) for x in ([terms.index(t) for t, _ in own], [s for _, s in own], [v[0] for v in own.values()], [v[1] for v in own.values()]))))

    def shown(t):
        return {(t.terms[a], int(b)): [int(c), int(d)] for a, b, c, d in zip(t.leaf, t.source, t.n, t.docs)}

    trie = divergence.Trie.merged(parts)
    assert shown(trie) == want and trie.terms == sorted({t for t, _ in want})
    rows = list(divergence.blocks("en", ["x", "y", "z"], trie, 7))
    assert all(len(x[4].split(b"\n")) <= 7 and x[2].startswith(x[3]) for x in rows)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), divergence._BLOCKS)], schema=divergence._BLOCKS)
    again = [(part[0], part[1], np.array(["xyz".index(s) for s in sources])[part[2]], *part[3:]) for _, sources, part in divergence.opened(batch)]
    assert shown(divergence.Trie.merged(again)) == want
    marks = [divergence.mark(t) for t in trie.terms]
    assert marks == sorted(marks)


def test_shares_are_exact():
    r = random.Random(1)
    for top in (100, 10**9, 10**15, (1 << 62)):
        count = np.array([r.randrange(top) for _ in range(50)])
        total = np.array([int(count.sum() % top) + int(count.max())])
        want = [1 + 10**9 * (int(c) + 5) // (int(total[0]) + 35) for c in count]
        assert divergence.shares(count, total, 7).tolist() == want


def test_candidates_keep_ties_in_byte_order():
    r = random.Random(2)
    items = [(f"{i:04d}".encode(), r.randrange(20)) for i in range(500)]
    r.shuffle(items)
    c = divergence.Candidates(50)
    for at in range(0, 500, 60):
        some = items[at : at + 60]
        c.offer([x for x, _ in some], np.array([v for _, v in some]))
    assert [(-m, x) for m, x in c.best] == [(v, x) for v, x in sorted(((v, x) for x, v in items), key=lambda y: (-y[0], y[1]))[:50]]


# --- filter interaction


def judged(seed=5):
    r = random.Random(seed)
    rows = documents(seed, 40)
    for k in range(60):
        n = r.choice([20, 60, 90])
        words = [prose(r, 1) for _ in range(n)]
        if r.random() < 0.4:
            words = words[: n // 3] * 3
        if r.random() < 0.4:
            words = [w.upper() for w in words]
        if r.random() < 0.4:
            words[3] += r.choice("#$%&*|")
        rows.append((1000 + k, " ".join(words), "en", r.choice(["s1", "S0", None, ""]), 1))
    rows += [(2000 + k, rows[k % 40][1], "en", "s9", 1) for k in range(0, 80, 2)]
    rows += [(None, rows[12][1], "en", "s9", 1), (None, "only here", "en", "s9", 1), (None, "only here", "en", "s9", 1), rows[20], rows[20]]
    labels = [(x[0], r.choice([0, 1, None]), r.choice([0, 1])) for x in rows if r.random() < 0.7] + [(20, 1, 0), (20, 0, 1), (None, 1, 1), (99999, 1, 1)]
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_audit_equals_sql(spark):
    rows, labels = judged()
    d, marks = frame(spark, rows).repartition(4), frame(spark, labels, LABELS)
    got = filter_audit.filter_audit(d, marks)
    want = sql({"documents": (rows, DOCS), "labels": (labels, LABELS)}, filter_audit.ORACLE)
    assert as_rows(got) == want and len(want) == 600 * len({r[3] or "" for r in rows})
    assert as_rows(filter_audit.filter_audit(crowded(d), crowded(marks))) == want


def test_audit_equals_brute_force(spark):
    rows, labels = judged(6)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, _, s, _ in rows:
        t = t or ""
        w = WS.findall(t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), t in least and (i is None or i > least[t]))) if bad}
        docs.append((s or "", fails, i in good, i in toxic))
    out = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_audit(frame(spark, rows), frame(spark, labels, LABELS)).collect()}
    for part in {x[0] for x in docs}:
        own, shapley = [x for x in docs if x[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [y for y in left if x in y[1]], [y for y in left if x not in y[1]]
                r = out[part, order, step]
                assert (r.kept, r.removed, r.good_lost, r.toxic_lost) == (len(left), len(gone), sum(y[2] for y in gone), sum(y[3] for y in gone))
                assert r.redundant == sum(x in y[1] for y in own) - len(gone) and r.unique_fails == sum(y[1] == {x} for y in own)
                shapley[x] += len(gone)
        assert all(out[part, o, s].shapley == shapley[o[s - 1]] for p, o, s in out if p == part)


def test_audit_sends_parts_on_early(spark, monkeypatch):
    rows, labels = judged(7)
    d, marks = frame(spark, rows), frame(spark, labels, LABELS)
    want = as_rows(filter_audit.filter_audit(d, marks))
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 1)
    assert as_rows(filter_audit.filter_audit(d.repartition(7), marks)) == want


def test_audit_of_little(spark):
    none = frame(spark, [], LABELS)
    assert filter_audit.filter_audit(frame(spark, []), none).count() == 0
    out = filter_audit.filter_audit(frame(spark, [(1, "word " * 300000 + "#", None, None, 1)]), none).collect()
    assert len(out) == 600 and {r.part for r in out} == {""} and {r.removed for r in out if r.filter_order == "ABCDE"} == {0, 1}


# --- SimHash


def brute_print(text):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, most=3):
    """Smallest index reachable for every fingerprint of a list."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("most_rows", [4096, 40])
def test_simhash_equals_brute_force(spark, most_rows):
    r = random.Random(11)
    rows = documents(3, 60)
    for k in range(80):  # families whose members differ in a word
        w = rows[9 + k % 5][1].split() * 3
        w[r.randrange(len(w))] = prose(r, 1)
        rows.append((500 + k, " ".join(w), "en", "s", 1))
    rows += [(None, rows[40][1], "en", "s", 1), (None, "nobody else says this", "en", "s", 1), rows[30], rows[30], (900, "\t\n ", None, None, None)]
    r.shuffle(rows)
    prints = [brute_print(x[1]) for x in rows]
    root = brute_classes(prints)
    least = {}
    for x, k in zip(rows, root):
        if x[0] is not None:
            least[k] = min(x[0], least.get(k, x[0]))
    want = sorted(((x[0], f"{p:016x}", least.get(k)) for x, p, k in zip(rows, prints, root)), key=repr)
    d = crowded(frame(spark, rows)).repartition(3)
    got = simhash.near_duplicates(d, most_rows=most_rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({k for k in root}) < len(set(prints))


def test_simhash_of_little(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    long = "some Words AND é more " * 60000
    out = simhash.near_duplicates(frame(spark, [(2, long, "en", "s", 1), (1, long.lower(), None, None, None)])).collect()
    assert {(r.fingerprint, r.component_id) for r in out} == {(f"{brute_print(long):016x}", 1)}


def clustered(n, seed, spread):
    """Random fingerprints, a dense cloud around one of them, and correlated bits."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    center = r.getrandbits(64)
    while len(out) < 2 * n:
        x = center
        for b in r.sample(range(64), r.randint(0, spread)):
            x ^= 1 << b
        out.add(x)
    out |= {x & ~0xFF | 0xFF * (x & 1) for x in list(out)[: n // 2]}
    return sorted(out)


@pytest.mark.parametrize("spread,most_rows", [(9, 40), (4, 100000)])
def test_bucket_links_lose_nothing(spark, spread, most_rows):
    from braidframe.llm.components import components

    prints = clustered(100, spread, spread)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    d = spark.createDataFrame([(x, k) for k, x in enumerate(signed)], "fp long, first_id long")
    order = simhash.grouped_bits(simhash.together(d), len(prints))
    assert sorted(order) == list(range(64))
    y = simhash.reordered(d, order)
    ys = {r.y: r.first_id for r in y.collect()}
    buckets = simhash.bucketed(y, most_rows=most_rows)
    if most_rows == 40:
        assert buckets.groupBy("path", "value").count().filter(f"count > {most_rows} AND path < {simhash.deepest(3)}").isEmpty()
    got = {ys[r.node]: ys[r.root] for r in components(simhash.verified(buckets, 3).distinct()).collect()}
    want = brute_classes(prints)
    mine = [got.get(k, k) for k in range(len(prints))]
    same = lambda x: sorted(tuple(sorted(i for i in range(len(x)) if x[i] == k)) for k in set(x))
    assert same(mine) == same(want)


def test_correlated_bits_share_a_partition():
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (4000, 64))
    for a in range(1, 16):
        x[:, a * 4] = np.where(r.random(4000) < 0.95, x[:, 0], x[:, a * 4])
    both = x.T @ x
    order = simhash.grouped_bits(both, 4000)
    assert set(order[:16]) == {a * 4 for a in range(16)}


def test_counts_within_a_distance_and_thresholds():
    r = np.random.default_rng(4)
    counts = r.integers(0, 5, 1 << 16)
    near = simhash.within(counts, 3)
    for v in (0, 12345, 65535):
        d = np.bitwise_count((np.arange(1 << 16) ^ v).astype(np.uint64))
        assert near[:, v].tolist() == [int(counts[d <= t].sum()) for t in range(4)]
    y = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    cost = simhash.costs(np.stack([np.roll(counts, i) * (1 + 50 * i) for i in range(4)]), 3)
    got = simhash.allocated(y, cost, 3)
    assert (got.sum(1) == 4).all()
    for row, k in zip(y, got):
        at = [int(simhash.field(np.array([row]), i)[0]) for i in range(4)]
        every = [sum(int(cost[i][c, at[i]]) for i, c in enumerate(ks)) for ks in np.ndindex(5, 5, 5, 5) if sum(ks) == 4]
        assert sum(int(cost[i][c, at[i]]) for i, c in enumerate(k)) == min(every)


def test_refined_partitions_cover_what_is_left():
    for path in (4, 7, 4 * 4 + 1, 7 * 16 + 6):
        fields = simhash.left_fields(path)
        whole = sum(int(f) for f in fields)
        assert all(int(a) & int(b) == 0 for a, b in combinations(fields, 2))
        assert whole.bit_count() == {4: 48, 7: 48, 17: 36, 118: 27}[path]
