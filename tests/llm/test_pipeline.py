"""The pipeline against its stages by brute force, each on its own input."""

import random
from collections import Counter

import corpus_pipeline
from braidframe.llm import queries, quality

from .data import clashing, documents, frame, prose
from .test_ops import classes


def test_stages(spark, tmp_path):
    rows = documents(5, 40)
    frame(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "ngram_jaccard", "pii", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    a = stage["quality"](spark, d, str(tmp_path))
    kept = {r.doc_id for r in quality.quality_rules(d).filter("kept").collect()}
    assert a.columns == d.columns and {r.doc_id for r in a.collect()} == kept
    b = stage["ngram_jaccard"](spark, a, str(tmp_path))
    want = {i for i, (_, c) in classes([r for r in rows if r[0] in kept]).items() if i == c}
    assert b.columns == d.columns and {r.doc_id for r in b.collect()} == want
    c = stage["pii"](spark, b, str(tmp_path))
    assert c.columns == d.columns and c.count() == len(want)
    m = stage["mixing"](spark, c, str(tmp_path))
    assert m.columns == d.columns
    copies = Counter(r.doc_id for r in m.collect())
    p = Counter()
    for r in stage["packing"](spark, m, str(tmp_path)).collect():
        p[r.doc_id] += r.length / r.doc_tokens
    assert {k: round(v, 6) for k, v in p.items()} == dict(copies)
    whole = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        whole[r.doc_id] += r.length / r.doc_tokens
    assert {k: round(v, 6) for k, v in whole.items()} == dict(copies)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, no rows at all, and further columns with names used inside."""
    r = random.Random(7)
    long = prose(r, 30000)
    near = long.rsplit(" ", 1)[0] + " end"
    short = prose(r, 40)
    rows = [(1, None, None, None, None), (None, short, "en", None, 9), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, near, None, "t", 1), (5, short + " x", "en", "s", 1)]
    d = clashing(frame(spark, rows))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name == "packing":
            got = Counter()
            for x in out.collect():
                got[x.doc_id] += x.length / x.doc_tokens
            assert {k: round(v, 6) for k, v in got.items()} == {1: 1, None: 1, 2: 1, 3: 2, 4: 1, 5: 1}
        else:
            assert out.columns == d.columns
            ids = sorted((x.doc_id or 0) for x in out.collect())
            if name == "quality":
                assert not {1, 2} & set(ids)
            elif name == "ngram_jaccard":
                # of the long texts one stays; what has no words is linked with nothing
                assert ids.count(3) == 1 and 4 not in ids and {1, 2} <= set(ids)
            elif name == "pii":
                assert ids == [0, 1, 2, 3, 3, 4, 5]
            else:
                # two rows have the id 3
                assert all(n <= (4 if i == 3 else 2) for i, n in Counter(ids).items())
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
