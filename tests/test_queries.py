"""Every core query with SQL gives what the SQL gives."""

import subprocess
import sys

import pytest

from quarryline.plans import corpus, crawl, events, frontier, hosts, legacy

MODULES = [corpus, frontier, crawl, events, hosts, legacy]
NAMES = [(m, k) for m in MODULES for k in m.SQL]


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[k for _, k in NAMES])
def test_query(same, module, name):
    same(module.QUERIES[name], module.SQL[name])


def test_queries_without_sql():
    """Only random rows have none."""
    assert {k for m in MODULES for k in m.QUERIES if k not in m.SQL} == {"log_sample"}


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:4] == ["query_id", "pos", "url", "score"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_optional_libraries():
    """A missing optional library takes its own queries away and no others."""
    from conftest import ROOT

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_two_terms' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= len(NAMES)
