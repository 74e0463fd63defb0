"""The training-data operators against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from braidframe.llm import chat, components, fingerprint, html_crf, jaccard_join, licenses, mixing, packing, pii, quality, suffix_dedup

from .data import SCHEMA, clashing, documents, frame

WS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sql(rows, text):
    import pandas as pd

    con = duckdb.connect()
    d = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])
    con.register("pd_documents", d)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM pd_documents")
    cur = con.execute(text)
    names = [x[0] for x in cur.description]
    return sorted((tuple(zip(sorted(names), [r[names.index(c)] for c in sorted(names)])) for r in cur.fetchall()), key=repr)


def as_rows(df):
    return sorted((tuple((c, r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_quality_equals_sql(docs, rows):
    assert as_rows(quality.quality_rules(docs)) == sql(rows, quality.ORACLE)


def test_quality_keeps_columns_and_clean_documents(spark, docs, rows, empty):
    kept = quality.kept_documents(clashing(docs))
    assert kept.columns == clashing(docs).columns
    want = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert 9 in want  # plain prose
    junk = frame(spark, [(1, "WHAT!! IS!! THIS!! SHOUT!! " * 1 + " ".join(f"W{i}!!" for i in range(30)), "en", "s", 1)])
    assert not quality.quality_rules(junk).first().kept
    assert quality.quality_rules(empty).count() == 0 and quality.kept_documents(empty).count() == 0


def test_quality_order_does_not_change_verdicts(docs):
    a = as_rows(quality.quality_rules(docs, quality.RULES[::-1], sample_rows=5))
    assert a == as_rows(quality.quality_rules(docs))


def test_cascade_takes_rejections_per_cost_among_those_left():
    hits = [(1, 1, 0), (1, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert quality.greedy_order(hits, [1.0, 0.5, 1.0]) == [1, 0, 2]  # 4, 3, 1 a second; then 1, 1; a tie goes by place
    assert quality.greedy_order(hits, [1.0, 1.0, 0.1]) == [2, 0, 1]
    assert quality.greedy_order([], [2.0, 1.0]) == [1, 0]


def test_measured_cost_stands_out_of_the_noise(spark, docs):
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text")).cache()
    dear = F.length(F.regexp_replace("text", r"(?<!\S)(\S+)(?=\s+\1(?!\S))", "")) < 0
    cheap, costly = quality.measured(sample, [F.length("text") > 5, dear])
    assert 0 < cheap < costly


def test_base_tests_are_members_of_the_cascade(docs):
    ordered = quality.order_rules(docs, quality.BASE_RULES + quality.RULES, lazy=True)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.BASE_RULES + quality.RULES)
    a = {r.doc_id for r in quality.kept_documents(docs, (quality.BASE_RULES + quality.RULES)[::-1], sample_rows=3).collect()}
    assert a == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}


def spark_hash(*values):
    """Spark's xxhash64 of several strings or longs."""
    import struct

    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_winnow(text, k=3, w=8):
    """(hash, position) of the smallest k-gram of every window, the rightmost of equal ones."""
    words = [spark_hash(x) for x in WS.findall(text)]
    grams = [spark_hash(*words[i : i + k]) for i in range(len(words) - k + 1)]
    if words and not grams:
        g = 0
        for x in words:
            g = spark_hash(g, x)
        grams = [g]
    at = {min(range(lo, min(lo + w, len(grams))), key=lambda i: (grams[i], -i)) for lo in range(max(1, len(grams) - w + 1))} if grams else set()
    return [(grams[i], i) for i in sorted(at)]


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(docs, rows):
    out = table(fingerprint.edited_fingerprints(docs))
    ids = sorted(out)
    text = {r[0]: r[1] or "" for r in rows}
    assert len(out) == len(rows)
    show = lambda f: ",".join(f"{p}:{h & (1 << 64) - 1:x}" for h, p in f)
    for k, i in enumerate(ids):
        t, nxt = text[i], text[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        f, e, n = brute_winnow(t), brute_winnow(edited), brute_winnow(nxt)
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (show(f), show(e))
        assert out[i].near_edited == pytest.approx(jaccard(f, e)) and out[i].near_next == pytest.approx(jaccard(f, n))
    long_ = [i for i in ids if len(WS.findall(text[i])) > 60]
    assert np.mean([out[i].near_edited for i in long_]) > 0.4


def test_winnowing_guarantee_and_rightmost_ties(spark):
    a = " ".join(f"w{i}" for i in range(40))
    shared = " ".join(f"s{i}" for i in range(10))  # window + k - 1
    d = frame(spark, [(1, a + " " + shared, "", "", 0), (2, shared + " " + a[::-1], "", "", 0), (3, "z " * 30, "", "", 0), (4, "z " * 9, "", "", 0)])
    f = {r.doc_id: {(x.hash): x.position for x in r.fingerprint} for r in fingerprint.fingerprints(d).collect()}
    assert set(f[1]) & set(f[2])
    got = [x.position for x in fingerprint.fingerprints(d.filter("doc_id = 3")).first().fingerprint]
    assert got == list(range(7, 28))  # of equal hashes in a window the rightmost
    assert list(f[4].values()) == [6]


def test_fingerprint_cases(spark, empty):
    assert fingerprint.edited_fingerprints(empty).count() == 0
    one = fingerprint.edited_fingerprints(frame(spark, [(5, "a b c d e f g h", "", "", 0)])).first()
    assert one.near_next == 1.0
    d = frame(spark, [(None, None, "", "", 0), (1, "x y", "", "", 0), (1, "x y", "", "", 0), (2, "x", "", "", 0)])
    assert fingerprint.edited_fingerprints(clashing(d)).count() == 4


def test_license_base_and_labels(spark, docs, rows, empty):
    extra = [(1000, "Intro. Released under the MIT License. GNU General Public License! CC BY", "", "", 0), (1001, "licensed under the apache license version 2 0", "", "", 0), (1001, "licensed under the apache license version 2 0", "", "", 0)]
    text = {**{r[0]: r[1] or "" for r in rows}, 1000: extra[0][1], 1001: extra[1][1]}
    d = docs.union(frame(spark, extra))
    assert licenses.license_scan(d).count() == len(rows) + 3
    for r in licenses.license_scan(clashing(d)).collect():
        w = licenses.template_words(text[r.doc_id])
        at, labels = [], set()
        for p, label in licenses.PHRASES.items():
            q = p.split()
            found = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            at += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    got = table(licenses.license_scan(d))
    assert got[1000].labels == "cc-by,gpl,mit,mit-statement" and "apache-2.0-statement" in got[1001].labels
    assert licenses.license_scan(empty).count() == 0


def test_license_texts_whole_edited_truncated_and_interleaved(spark):
    t = dict(licenses.public_templates())
    mit, bsd, apache = (t[x].split() for x in ("mit", "bsd-3-clause", "apache-2.0"))
    statement = licenses.STATEMENTS[1][1].replace("copy of this", "copy of exactly this")
    mixed, step = [], 40
    for i in range(0, max(len(mit), len(bsd)), step):
        mixed += mit[i : i + step] + bsd[i : i + step]
    edited = [w if i % 60 else f"{w} inserted" for i, w in enumerate(apache)]
    rows = [" ".join(x) for x in (mit, apache[: int(0.9 * len(apache))], edited, mixed, apache[: len(apache) // 2], ["before"] * 20 + statement.split() + ["after"])]
    got = {}
    for r in licenses.diagonal_votes(frame(spark, [(i, x, "", "", 0) for i, x in enumerate(rows)])).collect():
        got.setdefault(r.doc_id, set()).add(r.label)
    assert got[0] == {"mit", "mit-notice"} and {"apache-2.0"} <= got[1] and {"apache-2.0"} <= got[2]
    assert {"mit", "bsd-3-clause"} <= got[3]
    assert not any("apache-2.0" == x for x in got.get(4, set())) and got[5] == {"mit-notice"}


def brute_coverage(words, template, k=5, near=3, least=0.8, solid=10):
    """Share of a template's words under k-grams on merged solid diagonals."""
    at = {}
    for p in range(len(template) - k + 1):
        at.setdefault(tuple(template[p : p + k]), []).append(p)
    cells = {}
    for p in range(len(words) - k + 1):
        for tp in at.get(tuple(words[p : p + k]), ()):
            cells.setdefault(p - tp, set()).add(tp)
    runs, last = [], None
    for d in sorted(cells):
        if last is None or d - last > near:
            runs.append(set())
        runs[-1] |= cells[d]
        last = d
    need = min(solid, -(-int(least * 1000) * (len(template) - k + 1) // 1000))
    covered = {tp + j for r in runs if len(r) >= need for tp in r for j in range(k)}
    return len(covered) / len(template)


def test_license_labels_equal_brute_force(spark):
    import random

    r = random.Random(12)
    templates = [(x, y) for x, y in licenses.public_templates() if len(y) < 9000]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randint(1, 3)):
            x = r.choice(templates)[1].split()
            lo, hi = sorted(r.sample(range(len(x) + 1), 2)) if r.random() < 0.5 else (0, len(x))
            part = x[lo:hi]
            for _ in range(r.choice((0, 0, 3, 30))):
                if part:
                    part[r.randrange(len(part))] = r.choice(("changed", "two words"))
            w += part
        rows.append((i, " ".join(w), "", "", 0))
    got = {}
    for x in licenses.diagonal_votes(frame(spark, rows), tuple(templates)).collect():
        got.setdefault(x.doc_id, {})[x.label] = max(got.get(x.doc_id, {}).get(x.label, 0), x.coverage)
    for i, text, *_ in rows:
        words = licenses.template_words(text)
        want = {}
        for label, t in templates:
            c = brute_coverage(words, licenses.template_words(t))
            if c >= 0.8:
                want[label] = max(c, want.get(label, 0))
        assert {k: round(v, 9) for k, v in got.get(i, {}).items()} == {k: round(v, 9) for k, v in want.items()}, i


PII = [
    (1, "Mail ann.b@mail3.example.com or call 1 (040) 555-0631, IP 10.20.30.40.", "", "", 0),
    (2, 'token = "ad9b9ab81594e97f2d82ac69ac6544142c4f1d40" and 4111111111111111; again 4111 1111 1111 1111', "", "", 0),
    (3, "Not a card 4111111111111112, not an IP 999.1.1.1, number 1234567, not a date 2023-02-30", "", "", 0),
    (4, "Born 1990-07-14 or 14/07/1990, ssn 123-45-6789; ann.b@mail3.example.com", "", "", 0),
    (5, None, "", "", 0),
    (6, "", "", "", 0),
]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def test_pii(spark, empty):
    out = table(pii.findings(clashing(frame(spark, PII))))
    t = {i: r.text for i, r in out.items()}
    assert (out[1].n_email, out[1].n_phone, out[1].n_ip) == (1, 1, 1)
    assert "ann.b@" not in t[1] and "555-0631" not in t[1] and "10.20.30.40" not in t[1]
    assert re.search(r"call 1 \(\d{3}\) \d{3}-\d{4}, IP (\d{1,3}\.){3}\d{1,3}\.$", t[1])
    cards = re.findall(r"\d{16}|(?:\d{4} ){3}\d{4}", t[2])
    assert out[2].n_secret == 1 and out[2].n_card == 2 and len({c.replace(" ", "") for c in cards}) == 1
    assert luhn(cards[0]) and cards[0] != "4111111111111111"
    assert t[3] == PII[2][1] and out[3].n_replaced == 0
    assert out[4].n_date == 2 and out[4].n_ssn == 1
    a, b = re.search(r"Born (\d{4})-(\d\d)-(\d\d) or (\d\d)/(\d\d)/(\d{4})", t[4]).groups()[:3], re.search(r"or (\d\d)/(\d\d)/(\d{4})", t[4]).groups()
    assert a == b[::-1]  # one date, whatever its format
    mail = r"[a-z]{3}\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com"
    assert re.search(mail, t[1])[0] == re.search(mail, t[4])[0] != "ann.b@mail3.example.com"
    assert t[5] is None and t[6] == ""
    assert pii.findings(empty).count() == 0


def test_pii_formats_stay_and_values_stay_apart(spark):
    """Random values of every kind: as many different pseudonyms, in the format and valid as before."""
    import datetime
    import random

    r = random.Random(6)
    low = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    card = lambda shape: (lambda d: next(d + str(c) for c in range(10) if luhn(d + str(c))))("".join(str(r.randint(0, 9)) for _ in range(shape - 1)))
    day = lambda lo: datetime.date(r.randint(401, 9999), r.randint(1, 12), r.randint(lo, 28))
    amex = lambda d: f"{d[:4]} {d[4:10]} {d[10:]}"
    long_card = lambda d: f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:16]} {d[16:]}"
    makers = {
        "email": lambda: f"{low(r.randint(1, 12))}.{low(3)}@{low(r.randint(2, 9))}.org",
        "secret": lambda: "token=" + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 64)))),
        "phone": lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(0, 9999):04d}",
        "abroad": lambda: f"+{r.randint(20, 98)} {r.randint(10, 9999)} {r.randint(10000, 99999)} {r.randint(10, 999)}",
        "card": lambda: r.choice((lambda: card(13), lambda: amex(card(15)), lambda: long_card(card(19)), lambda: card(16)))(),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "date": lambda: r.choice((day(1).isoformat(), "{0:%d/%m}/{0.year:04d}".format(day(1)), "{0:%m/%d}/{0.year:04d}".format(day(13)))),
    }
    valid = {
        "email": r"[a-z0-9]+\.[a-z0-9]{3}@[a-z0-9]+\.org", "secret": r"token=[0-9a-f]+", "phone": r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", "abroad": r"\+\d\d \d+ \d{5} \d+", "card": r"[\d ]+",
        "ssn": r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", "ip": r"(\d{1,3}\.){3}\d{1,3}", "date": r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}",
    }
    rows = [(k, v) for k, make in makers.items() for v in {make() for _ in range(150)}]
    d = frame(spark, [(i, f"about {v} here", "", "", 0) for i, (_, v) in enumerate(rows)])
    out, new = table(pii.findings(d)), {}
    for i, (kind, v) in enumerate(rows):
        text = out[i].text
        assert text.startswith("about ") and text.endswith(" here")
        x = text[6:-5]
        assert out[i][f"n_{kind}"] == out[i].n_replaced == 1, (kind, v)
        assert re.fullmatch(valid[kind], x) and re.sub(r"[0-9a-z]", "", x) == re.sub(r"[0-9a-z]", "", v), (kind, v, x)
        assert kind == "ip" or len(x) == len(v)
        if kind == "card":
            assert luhn(x.replace(" ", ""))
        if kind == "ip":
            assert all(int(o) < 256 for o in x.split("."))
        if kind == "date":
            y, a, b = (x[:4], x[5:7], x[8:]) if "-" in x else (x[6:], x[3:5], x[:2])
            datetime.date(int(y), *((int(a), int(b)) if "-" in x or int(a) <= 12 else (int(b), int(a))))
            us = lambda s: "/" in s and int(s[3:5]) > 12
            assert us(x) == us(v)
        assert new.setdefault((kind, x), v) == v
    same = table(pii.findings(frame(spark, [(1, "Ann.B@Mail3.example.com", "", "", 0), (2, "ann.b@mail3.example.com", "", "", 0), (3, "+1 (040) 155-0631", "", "", 0)])))
    assert same[1].text.lower() == same[2].text and same[1].text[0].isupper() and same[1].text[4].isupper()
    assert re.fullmatch(r"\+1 \([01]\d\d\) [01]\d\d-\d{4}", same[3].text)


def test_feistel_is_a_bijection_and_inverts(spark):
    d = spark.range(189 * 37).select(F.floor(F.col("id") / 37).alias("l"), (F.col("id") % 37).alias("r"))
    d = d.select("l", "r", pii.feistel(F.col("l"), F.col("r"), F.lit(189).cast("long"), F.lit(37).cast("long"), "k", "date").alias("x"))
    got = [(r.l, r.r, r.x.l, r.x.r) for r in d.collect()]
    assert len({x[2:] for x in got}) == 189 * 37
    assert all(pii.unfeistel(c, e, 189, 37, "k", "date") == (a, b) for a, b, c, e in got[:200])


def test_pii_columns_pass_through(docs):
    d = clashing(docs)
    assert pii.pseudonymised(d).columns == d.columns
    assert as_rows(pii.pseudonymised(d)) == as_rows(d)  # nothing personal in it


def test_mixing_equals_sql(docs, rows):
    near = lambda x: [tuple((k, round(v, 6) if isinstance(v, float) else v) for k, v in r) for r in x]
    assert near(as_rows(mixing.mix(docs).drop("repeats"))) == near(sql(rows, mixing.ORACLE))


def test_mixing_targets_and_repeats(docs, rows, empty, spark):
    m = mixing.mix(docs).collect()
    src = {r[0]: r[3] for r in rows}
    by = {}
    for r in m:
        assert r.taken <= 2 * r.size
        by.setdefault(src[r.doc_id], []).append(r)
    total = sum(r.size for r in m)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        n = sum(r.size for r in v)
        assert v[0].source_size == n and v[0].target <= 2 * n + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    d = clashing(docs)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    want = Counter({r.doc_id: r.repeats for r in m if r.repeats})
    assert Counter(r.doc_id for r in out.collect()) == want
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = frame(spark, [(1, None, "", None, 0), (2, "", "", "a", 0)])
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


@pytest.fixture(scope="module")
def small_packing():
    p = packing.public_packing()
    return packing.Packing(p.tokenizer, p.ranks, p.pattern, block_tokens=20_000)


def test_mixing_takes_some_of_repeated_rows(spark):
    """Rows without an id that are equal in all are taken one by one, and no source is far from its target."""
    r = np.random.default_rng(3)
    words = lambda n: " ".join(["w"] * n)
    rows = [(None, words(10), "en", "a", 1)] * 200 + [(i, words(int(r.integers(5, 30))), "en", "b", 1) for i in range(60)] + [(i, words(20), "en", "c", 1) for i in range(50)]
    rows += [(7, words(300), "en", "d", 1)] * 5 + [(None, words(300), "en", None, 1)] * 3 + [(None, words(7) + f" {i}", "en", None, 1) for i in range(100)]
    for parts in (1, 4):
        out = mixing.mix(frame(spark, rows).repartition(parts)).collect()
        assert len(out) == len(rows) and all(x.taken <= 2 * x.size for x in out)
        for size in {x.source_size for x in out}:
            own = [x for x in out if x.source_size == size]
            assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
        again = mixing.mixed(frame(spark, rows).repartition(parts))
        assert again.count() == sum(x.repeats for x in out)
    assert as_rows(mixing.mix(frame(spark, rows)).drop("repeats")) == sql(rows, mixing.ORACLE)


def test_packing(docs, rows, small_packing, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(small_packing.tokenizer)
    out = packing.packed(clashing(docs), small_packing).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    tokens = sum(r.length for r in out)
    assert len(by_seq) * 1024 - tokens < 1024 * 12  # less than one sequence a block
    assert packing.packed(empty, small_packing).count() == 0


def test_packing_balances_cost():
    got = packing.balanced([500, 500, 500, 500, 24, 24], 1024, 1.0, 1.0)
    room = Counter()
    for _, _, n, s in got:
        room[s] += n
    assert room == {0: 1024, 1: 1024}
    parts = packing.balanced([1000, 1000, 1000], 1024, 1.0, 0.0)
    assert sum(n for *_, n, _ in [(a, b, c, d) for a, b, c, d in parts]) == 3000


def brute_balanced(lengths, room, linear, quadratic):
    """The dealt rule word by word: longest first, to the cheapest sequence with room for it, else cut over the cheapest with any."""
    left, cost, out = [room] * -(-sum(lengths) // room), [0.0] * -(-sum(lengths) // room), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, n = 0, lengths[item]
        while n:
            fit = [s for s in range(len(left)) if left[s] >= n] or [s for s in range(len(left)) if left[s]]
            s = min(fit, key=lambda x: (cost[x], x))
            k = min(n, left[s])
            out.append((item, start, k, s))
            left[s] -= k
            cost[s] += linear * k + quadratic * k * k
            start, n = start + k, n - k
    return out


def test_packing_takes_the_cheapest_of_all_sequences_with_room():
    r = np.random.default_rng(2)
    for lengths in ([500, 500, 30], [1], [], [1023] * 5, r.integers(1, 1024, 300).tolist(), np.minimum(1023, np.exp(r.normal(4.5, 1.2, 500)).astype(int) + 1).tolist()):
        for q in (0.0, 1 / 1024):
            assert packing.balanced(lengths, 1024, 1.0, q) == brute_balanced(lengths, 1024, 1.0, q)


def test_tokenizers_agree_on_random_texts(small_packing):
    import random

    e, r = packing.Encoder(small_packing), random.Random(8)
    pools = [range(32, 127), [9, 10, 32, *range(0xA1, 0x180)], [32, *range(0x370, 0x3FF), *range(0x4E00, 0x4E80)], [*range(0x20, 0x7F), 0x301, 0x1F600, 0x200D, 0xA0, 0x85, 0x2028, 0]]
    for k in range(1500):
        pool = [c for p in r.sample(pools, r.randint(1, 3)) for c in p]
        t = "".join(chr(r.choice(pool)) for _ in range(r.randint(0, 60)))
        assert e(t) == e.full.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_of_a_very_long_text(spark, small_packing):
    text = "long words of one text " * 40_000
    out = packing.packed(frame(spark, [(1, text, "", "", 0), (2, "short", "", "", 0)]).coalesce(1), small_packing).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == out[0].doc_tokens > 200_000
    assert len({r.sequence_id for r in out}) * 1024 - sum(r.length for r in out) < 2 * 1024


def test_both_tokenizers_agree(small_packing, rows):
    e = packing.Encoder(small_packing)
    for t in [r[1] for r in rows if r[1]] + ["a  b\n\n c\t d", "it's we'll 123 4567", "<|endoftext|> x", "  "]:
        assert e(t) == e.full.encode(t, add_special_tokens=False).ids


CONV = [(1, 0, "user", "hi # there"), (1, 1, "assistant", "### User: </turn>\nx \\ y"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "only"), (None, 0, "assistant", "n"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, "assistant", "tie a"), *[(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 3) for i in range(60)]]
CONV_SCHEMA = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    c = spark.createDataFrame(CONV, CONV_SCHEMA).repartition(3)
    out = table(chat.digests(chat.turn_spans(clashing(chat.with_added(c)))), "conv_id")
    groups = {}
    for conv, turn, role, text in [*CONV, (-7, 0, "user", chat.ADDED_TEXT), (-7, 1, "assistant", chat.ADDED_TEXT)]:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(out) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        r = out[conv]
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        full = chat.turn_template([{"role": role, "text": text} for _, role, text in turns])
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(full) and not r.rewrites
    assert chat.digests(chat.turn_spans(c.limit(0))).count() == 0


def test_rewriting_templates_are_seen():
    def counts(turns):
        return f"{len(turns)} turns\n" + "".join(t["text"] for t in turns)

    s = chat.Incremental(counts)
    assert s.add({"role": "user", "text": "a"}) is None or s.add({"role": "user", "text": "b"}) is None
    assert s.rewrites

    def last_only(turns):
        return "".join(t["text"] if i == len(turns) - 1 else "[cut]" for i, t in enumerate(turns))

    s = chat.Incremental(last_only)
    assert s.add({"role": "user", "text": "hello"}) is not None
    assert s.add({"role": "user", "text": "b"}) is None and s.rewrites


def test_long_conversations_are_rendered_whole(spark):
    def numbered(turns):
        return "".join(f"[{i}] {t['text']}\n" for i, t in enumerate(turns))

    def last_twenty(turns):
        return "".join(f"{t['text']}\n" for t in turns[-20:])

    turns = [{"role": "user", "text": f"t{i}"} for i in range(40)]
    s = chat.Incremental(numbered)
    placed = [s.add(t) for t in turns]
    assert "".join(p[0] for p in placed) == numbered(turns) and not s.rewrites
    assert all(numbered(turns)[p[1] + p[2] : p[1] + p[3]] == t["text"] for p, t in zip(placed, turns))
    c = spark.createDataFrame([(1, i, "user", t["text"]) for i, t in enumerate(turns)], CONV_SCHEMA)
    out = sorted(chat.turn_spans(c, last_twenty).collect(), key=lambda r: r.turn_no)
    assert [r.rewrites for r in out] == [i >= 20 for i in range(40)]
    assert all((r.formatted is None) == r.rewrites for r in out)


def test_rewrites_are_seen_at_every_length():
    """A banner that stands before the history at one length only, and templates that look far back."""
    turns = [{"role": ("user", "assistant")[i % 2], "text": f"t{i}" * (i % 4)} for i in range(90)]

    def banner(at):
        return lambda x: ("BANNER " if len(x) == at else "") + "".join(f"<{t['text']}>" for t in x)

    for at in (1, 2, 20, 33, 89, 90):
        placed = chat.located(turns, banner(at))
        # the banner at the start is history for the next turn, which takes it away
        first = 1 if at == 1 else at - 1
        assert [p is None for p in placed] == [i >= first for i in range(90)]

    def late(x):  # looks back nine turns once there are more than eighteen
        return "".join(f"<{t['text']}>" + ("|" if i > 18 and len(x[i - 9]["text"]) > 2 else "") for i, t in enumerate(x))

    placed = chat.located(turns, late)
    assert "".join(p[0] for p in placed) == late(turns) and all(late(turns)[p[1] + p[2] : p[1] + p[3]].startswith(t["text"]) for p, t in zip(placed, turns))


def test_texts_are_placed_exactly():
    """Texts that begin or end like the template around them, as verdicts and fuzzing found them."""
    import random

    r = random.Random(4)
    templates = (
        lambda x: "".join(f"{t['role']}\n{t['text']}\n" for t in x),
        lambda x: "".join(f"<s>{t['text']}</s>" for t in x),
        lambda x: "".join(f"q{t['text']}v" for t in x),
        lambda x: "".join(f"x{t['text']}" for t in x),
        lambda x: "".join(f"{t['text']}{t['role']}" for t in x),
        lambda x: "[]" + "".join(f"{i}:{t['text']}\n\n" for i, t in enumerate(x)),
    )
    texts = ["\nhello", "<b>x", "</s>", "", "\n", "q", "v", "qv", "x", "user", "0:", "é\n\n", " a "] + ["".join(r.choice("<s>/bqvx\n: ") for _ in range(r.randint(0, 6))) for _ in range(60)]
    for template in templates:
        turns = [{"role": "user", "text": t} for t in texts]
        placed = chat.located(turns, template)
        assert all(p[0][p[2] : p[3]] == t for p, t in zip(placed, texts))
    shout = chat.located([{"role": "u", "text": t} for t in texts], lambda x: "".join(f"Q{t['text'].upper()}V" for t in x))
    assert all(p[0][p[2] : p[3]] == t.upper() for p, t in zip(shout, texts))


def test_html_held_out_accuracy():
    m = html_crf.trained()
    right = n = 0
    for page, main in html_crf.labelled_pages(120, 77):
        blocks, wanted = html_crf.leaf_blocks(page), set(main)
        for b, y in zip(blocks, m.decode(html_crf.block_features(blocks))):
            n += 1
            right += (b.text in wanted) == bool(y)
    assert right / n > 0.98


def test_html_cases(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/x">Home</a></nav><article><h1>A &amp; B</h1><p>First <b>bold</b>\n  text<br>more.</p><script>var a="</p>";</script><p>Second &eacute;.</p></article><div class="comments"><p>I like it, really.</p></div><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p"), (5, "u", "<article><p>cut off &am")]
    out = html_crf.extracted(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == 6 and by[1] == "A & B\nFirst bold text more.\nSecond é."
    assert by[2] == by[3] == by[4] == ""
    assert all(r.n_chars == len(r.text) for r in out)


#: Pages by hand in several makes: (html, wanted text).
PAGES = [
    ("<article><p>It rained in the hills for nine days, and the river rose above the old bridge.</p></article>", "It rained in the hills for nine days, and the river rose above the old bridge."),
    ("<p>One lone paragraph, without any page around it, is the text of the page.</p>", "One lone paragraph, without any page around it, is the text of the page."),
    (
        "<html><body><div id=wrap><div class='site-header'><a href=/>Home</a></div><div class='post-content'><h1>A walk</h1><p data-x=it's>We left at dawn, in the fog.</p><p>The second part began at the mill.</p>"
        "<p>By night we were home again.</p></div><div class='footer'>&copy; 2020 The Walkers</div></div></body></html>",
        "A walk\nWe left at dawn, in the fog.\nThe second part began at the mill.\nBy night we were home again.",
    ),
    (
        "<body><article><h1>Icons</h1><p>Text before the icon <svg width=\"1\"/> and text behind it, on one line.</p><p>An open drawing <svg><path d='M0 0'><text>no</text><p>ends at the next paragraph, as it should.</p></article>",
        "Icons\nText before the icon and text behind it, on one line.\nAn open drawing\nends at the next paragraph, as it should.",
    ),
    (
        "<article><h2>Sums</h2><p>If a &lt; b and <math><mi>x</mi><mo>=</mo><mn>3</mn><annotation>x=3</annotation></math>, then 2 < 3 holds, <3.</p><p>A &am<b>p;</b> is not a reference, &amp; is.</p>"
        "<p><!--> Short comments end at once. <!-- long <p>gone</p> --> Done.</p></article>",
        "Sums\nIf a < b and x=3, then 2 < 3 holds, <3.\nA &amp; is not a reference, & is.\nShort comments end at once. Done.",
    ),
]


def test_html_tags_as_browsers_read_them():
    m = html_crf.trained()
    for page, want in PAGES:
        assert html_crf.main_text(page, m) == want
    texts = [b.text for b in html_crf.leaf_blocks("<p>a</p><noscript><p>shown without scripts<object>and an object</object><canvas>and a canvas</canvas><p>b<textarea>form</textarea><script>x</script>c")]
    assert texts == ["a", "shown without scriptsand an objectand a canvas", "bc"]
    assert [b.text for b in html_crf.leaf_blocks('<div title="a>b" class=x/>one</div><a href=/y/>two</a></3><?php x?>')] == ["one", "two"]
    assert html_crf.leaf_blocks('<p title="never closed>text') == []


def test_html_reading_is_linear_in_depth():
    import time

    def took(n):
        page = "".join(f"<div class='c{i} deep'>x{i}</b></i></section>" for i in range(n))
        began = time.perf_counter()
        m = html_crf.trained()
        assert len(html_crf.leaf_blocks(page, m.names)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 40 * took(4_000)


def test_viterbi_and_gradient_by_brute_force():
    from itertools import product

    r = np.random.default_rng(5)
    names = list("abcdef")
    model = html_crf.ChainModel({x: i for i, x in enumerate(names)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)))
    for n in range(1, 8):
        f = [[names[i] for i in r.integers(0, 6, 3)] for _ in range(n)]
        s = model.scores(f)
        score = lambda y: sum(s[t, y[t]] for t in range(n)) + sum(model.move[y[t], y[t + 1]] for t in range(n - 1))
        assert score(model.decode(f)) == pytest.approx(max(map(score, product((0, 1), repeat=n))))
    # at the optimum of the likelihood, expected features are the observed ones but for the penalty
    pages = [([["a"], ["b"], ["a", "c"]], [1, 0, 1]), ([["b", "c"], ["a"]], [0, 0]), ([["c"]], [1])]
    t = html_crf.train(pages, steps=3000, rate=0.02, penalty=0.05)
    gradient = np.zeros_like(t.emit)
    for f, gold in pages:
        s = t.scores(f)
        ways = list(product((0, 1), repeat=len(f)))
        p = np.exp([sum(s[k, y[k]] for k in range(len(f))) + sum(t.move[y[k], y[k + 1]] for k in range(len(f) - 1)) for y in ways])
        for y, w in [(gold, 1.0), *((y, -x) for y, x in zip(ways, p / p.sum()))]:
            for k, names_ in enumerate(f):
                for x in names_:
                    gradient[t.index[x], y[k]] += w
    assert np.abs(gradient / len(pages) - 0.05 * t.emit).max() < 1e-3


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    s = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("bucket,block", [(16, 2000), (2, 3)])
def test_jaccard_join(docs, rows, bucket, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(clashing(docs), bucket, block).collect()}
    assert got == classes(rows)


def test_jaccard_large_families(spark):
    """Families of near copies far beyond the bucket, with edits around the threshold, and a passage that strangers share."""
    import random

    from .data import prose

    r = random.Random(4)
    rows, n = [], 0
    passage = prose(r, 50)
    for _ in range(2):
        base = prose(r, 120).split()
        for _ in range(30):
            w = list(base)
            for k in r.sample(range(len(w)), r.randint(0, 4)):
                w[k] = f"e{r.randint(0, 10**9)}"
            rows.append((n, " ".join(w), "", "", 0))
            n += 1
    for _ in range(30):
        rows.append((n, prose(r, 40) + " " + passage, "", "", 0))
        n += 1
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame(spark, rows).repartition(4), 4, 10).collect()}
    assert got == classes(rows)


def joined(spark, rows, **how):
    return {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame(spark, rows).repartition(4), **how).collect()}


def test_jaccard_groups_of_many_members(spark, monkeypatch):
    """Copies with one word changed, many of which have one prefix and size; with two members a group at most for all pairs."""
    import random

    from .data import prose

    r = random.Random(14)
    base, rows = prose(r, 120).split(), []
    for i in range(160):
        w = list(base)
        w[r.randrange(len(w))] = f"e{r.randint(0, 10**9)}"
        rows.append((i, " ".join(w), "", "", 0))
    rows += [(200 + i, prose(r, 60), "", "", 0) for i in range(20)]
    prefixes = Counter(tuple(s[: jaccard_join.prefix_length(len(s))]) for s in (jaccard_join.Shingler()(t.encode()) for _, t, *_ in rows))
    assert max(prefixes.values()) > 2
    assert joined(spark, rows, bucket=4, block=20, members=2) == classes(rows)
    # hashes that tell fewer groups apart only make more members of one
    monkeypatch.setattr(jaccard_join, "group_key", lambda prefix, n: n % 3 + 1)
    assert joined(spark, rows, bucket=4, block=20, members=2) == classes(rows)


def test_jaccard_rows_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(100)]
    edit = lambda k: " ".join("x" + w if 10 * k <= i < 10 * k + 2 * bool(k) else w for i, w in enumerate(words))
    a, n, b = " ".join(words[:92] + [f"a{i}" for i in range(8)]), " ".join(words), " ".join([f"b{i}" for i in range(8)] + words[8:])
    link = lambda x, y: 100 * len(shingles(x) & shingles(y)) >= 80 * len(shingles(x) | shingles(y))
    assert link(a, n) and link(n, b) and not link(a, b) and edit(0) == n
    rows = [(4, a, "", "", 0), (None, n, "", "", 0), (9, b, "", "", 0), (None, "alone one two three four five", "", "", 0), (None, "alone one two three four five", "", "", 0), (None, None, "", "", 0)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (0, 4), (4, 4), (9, 4)]
    kept = jaccard_join.deduplicated(clashing(frame(spark, rows))).collect()
    assert sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in kept) == [(0, ""), (0, "alone"), (4, a[:5])]


def test_jaccard_keeps_one_row_of_repeated_ones(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(3, text, "", "", 0), (3, text, "", "", 0), (3, "another text that shares the id only here", "", "", 0), (5, text + " more", "", "", 0), (6, "", "", "", 0), (6, "", "", "", 0)]
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.deduplicated(frame(spark, rows)).collect())
    assert kept == [(3, "another text that shares the id only here"), (3, text), (6, ""), (6, "")]


def test_jaccard_cases(spark, empty):
    assert jaccard_join.near_duplicates(empty).count() == 0
    d = frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0), (3, "A b", "", "", 0), (4, "a  B", "", "", 0), (4, "a  B", "", "", 0)])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(d).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3)]
    kept = jaccard_join.deduplicated(clashing(d))
    assert kept.columns == clashing(d).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (60, 100), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 60: 50, 100: 50}


def removed(rows, width=50):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        mask, own = np.zeros(len(b), bool), set()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                mask[k : k + width] = True
            own.add(s)
        seen |= own
        kept = bytes(np.frombuffer(b, np.uint8)[~mask]) if len(b) else b""
        runs = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out[i] = (len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(clashing(docs)).collect()}
    assert got == removed(rows)
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_dedup_on_low_alphabets(spark):
    import random

    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab") * r.randint(1, 30) for _ in range(r.randint(1, 30))), "", "", 0) for i in range(40)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(frame(spark, rows).repartition(3)).collect()}
    assert got == removed(rows)


def test_suffix_dedup_shared_ids(spark):
    a = "".join(chr(97 + i * 7 % 26) for i in range(120)) + "x" * 3
    rows = [(1, a, "", "", 0), (1, "zz" + a, "", "", 0), (1, a, "", "", 0), (2, a + "end", "", "", 0), (None, "q" + a, "", "", 0)]
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in suffix_dedup.deduplicated(frame(spark, rows)).collect())
    assert out == [(-1, 123), (1, 0), (1, 0), (1, 0), (2, 123)]


def test_suffix_dedup_keys_rows_that_share_an_id(spark, monkeypatch):
    """Rows without an id are judged each by itself, and their number costs in proportion."""
    import random

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    p = text(120)
    # y shares nothing, whatever hash it has in common with the row that does
    rows = [(1, p, "", "", 0), (None, p + text(10), "", "", 0)] + [(None, text(140), "", "", 0) for _ in range(300)] + [(None, p[20:90] + text(9), "", "", 0)]
    out = suffix_dedup.deduplicated(frame(spark, rows).repartition(4)).collect()
    assert sorted(x.n_removed for x in out if x.n_removed) == [70, 120] and len(out) == len(rows)
    assert {x.n_spans for x in out} == {0, 1}


@pytest.mark.parametrize("most", [2, 5])
def test_suffix_dedup_splits_hot_sides(spark, monkeypatch, most):
    """A passage in many texts with other bytes around it, where every side is split until single windows are left."""
    import random

    r = random.Random(most)
    text = lambda n: "".join(r.choice("abcd") for _ in range(n))
    passages = [text(90), text(55), "ab" * 40]
    rows = [(i, text(r.randint(0, 3)) + passages[i % 3][r.randint(0, 2) :] + text(r.randint(0, 40)), "", "", 0) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "MOST_FRAGMENTS", most)
    split = []
    halved = suffix_dedup.halved
    monkeypatch.setattr(suffix_dedup, "halved", lambda x: split.append(1) or halved(x))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(frame(spark, rows).repartition(3)).collect()}
    assert got == removed(rows) and split


def test_suffix_dedup_shares_runs_of_groups_in_bulk(monkeypatch):
    """What fragments share, over runs that end within batches, in far fewer calls of NumPy than there are fragments."""
    import cProfile
    import pstats
    import random

    import pyarrow as pa

    class Pieces:  # hands back what is run in tasks
        sparkSession = None
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(suffix_dedup, "shuffle_width", lambda _: 1)
    r = random.Random(8)
    rows, want = [], set()
    for side in range(700):
        # sides have bytes of their own; in every third the fragments are of one document
        passage = bytes(r.randint(97, 104) for _ in range(84))
        ords = sorted([side] * 3 if side % 3 == 0 else [r.randint(0, 5) for _ in range(r.randint(1, 6))])
        for k, o in enumerate(ords):
            a, b = r.randint(0, 15), r.randint(66, 84)
            rows.append((side, 0, 17, o, 100 * side + k, 7 * k, 34 - a, passage[a:b]))
        own = [x for x in rows if x[0] == side]
        for x in own:
            for at in range(len(x[7]) - 49):
                if any(y[3] < x[3] and x[7][at : at + 50] in y[7] for y in own):
                    want |= {(x[4], x[5] + at + i) for i in range(50)}
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), suffix_dedup._PIECES)], schema=suffix_dedup._PIECES)
    run = suffix_dedup.shared(Pieces(), 20_000)
    profile = cProfile.Profile()
    out = profile.runcall(lambda: list(run(whole.slice(i, 501) for i in range(0, len(rows), 501))))
    spans = [x for b in out for x in zip(*(c.to_pylist() for c in b.columns))]
    assert {(uid, i) for uid, s, e in spans for i in range(s, e)} == want and len(out) > 3
    calls = {f[2]: x[1] for f, x in pstats.Stats(profile).stats.items() if "numpy" in f[0]}
    assert max(calls.values()) < len(rows) / 4


def test_spans_are_joined_where_they_touch():
    import random

    import pyarrow as pa

    r = random.Random(1)
    span = lambda a: {"start": a, "end": a + r.randint(1, 9)}
    lists = [[span(r.randint(0, 40)) for _ in range(r.randint(0, 6))] for _ in range(500)] + [[], [{"start": 5, "end": 9}, {"start": 9, "end": 10}]]
    cover = pa.array([[], *lists], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))).slice(1)
    start, end, bounds = suffix_dedup.merged_spans(cover)
    for k, own in enumerate(lists):
        want: list[list[int]] = []
        for c in sorted(own, key=lambda c: (c["start"], c["end"])):
            if want and c["start"] <= want[-1][1]:
                want[-1][1] = max(want[-1][1], c["end"])
            else:
                want.append([c["start"], c["end"]])
        assert [list(x) for x in zip(start, end)][bounds[k] : bounds[k + 1]] == want
    assert suffix_dedup.merged_spans(cover.slice(0, 0)) == ([], [], [0])


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for alphabet in (2, 4, 30):
        for n in (1, 2, 3, 50, 400):
            t = np.r_[r.integers(1, alphabet + 1, n), 0].astype(np.uint8)
            b = t.tobytes()
            order = suffix_dedup.suffix_array(t, n + 8)
            assert order.tolist() == sorted(range(n + 1), key=lambda i: b[i:])
            want = [0] + [next((k for k in range(20) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b) or y + k >= len(b)), 20) for x, y in zip(order.tolist(), order.tolist()[1:])]
            assert suffix_dedup.common_prefixes(order, b, 20).tolist() == want


def test_suffix_dedup_tells_fragments_apart(spark):
    # after 140 bytes in common the texts differ, but the upper halves of the first hash of a fragment that has 10 bytes more are equal
    common = "gulpgqsuwzqaulhtnjlsdcqvqgdtvijxgmphetgwqagyfaukrvttjlmqmjevpbfntxmdohzctvoozmzczscpyibaevspyxlkyaipzgxnrrvdgsrwzxivztvcnkclznziowdygwuzjdbs"
    rows = [(1, common + "akquhvnogxlkosyyaukynjpcrsaebbuvuzzsvyrqdundsjvfwx", "", "", 0), (2, common + "mwmohlvsfchlsjpteyvookqdjscyzcvyrqdpsrmcyxxzbrdcmp", "", "", 0)]
    halves = [int(suffix_dedup.Surroundings()(t.encode(), [(np.array([66]), np.array([150]))])[0][0]) >> 32 for _, t, *_ in rows]
    assert halves[0] == halves[1]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == removed(rows)
