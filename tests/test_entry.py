import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_training_operators():
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "braidframe.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("braidframe.llm") or k == "corpus_pipeline"}
    import braidframe

    llm = braidframe.__dict__.pop("llm", None)
    sys.meta_path.insert(0, Missing())
    try:
        assert not any(n.startswith("op") for n in importlib.reload(entry).queries())
    finally:
        del sys.meta_path[0]
        sys.modules.update(held)
        if llm is not None:
            braidframe.llm = llm
        importlib.reload(entry)


def test_queries_read_whole_tables():
    """No registered query cuts its tables by a remainder, a quantity or a number of rows."""
    import inspect
    import re

    from braidframe.plans import queries_core, queries_extra, queries_graph, queries_lift, queries_more

    for m in (queries_core, queries_extra, queries_graph, queries_lift, queries_more):
        text = inspect.getsource(m)
        assert not re.search(r"path_id % |l_quantity|\.limit\(|\.sample\(", text), m.__name__


def test_components_of_the_whole_graph(spark):
    import duckdb

    from braidframe.plans import catalog

    sf = "/root/testdata/sf0.001"
    root = {n: n for (n,) in duckdb.sql(f"SELECT p_partkey + 1 FROM '{sf}/part.parquet'").fetchall()}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for first, other in duckdb.sql(f"SELECT min(l_partkey) OVER (PARTITION BY l_orderkey) + 1, l_partkey + 1 FROM '{sf}/lineitem.parquet'").fetchall():
        a, b = find(first), find(other)
        root[max(a, b)] = min(a, b)
    got = {r.node_id: r.component for r in catalog.QUERIES["feedback_arc_order"](spark, sf).collect()}
    assert got == {n: find(n) for n in root}
