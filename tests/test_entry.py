"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from advisium.plans import queries
from tests.conftest import ROOT

CHEAP = [
    "vendor_key", "product_key", "keys_agree", "ident_key", "cpe_key", "base_id", "purl", "quoted_text", "low_entropy", "version_parse", "version_order", "range_kind", "range_describe", "range_contains", "fuzzy_ratio", "ssvc_decide",
    "status_gate", "match_best", "near_miss_vendor", "vex_products", "corpus_stats", "revision_dedupe", "run_diff", "search_bm25", "header_aliases", "label_scan",
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "customer part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda x: None if x is None else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHEAP)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(got.fetchall(), names)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 50


def test_without_the_subpackage():
    """Its folder and the pipeline may be deleted."""
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('advisium.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'match_best' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.queries()), list(e.queries())
assert e.oracle_sql().keys() <= e.queries().keys()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_other_import_errors_are_not_hidden():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'advisium.plans.bridge':
            raise ModuleNotFoundError('gone', name=name)
sys.meta_path.insert(0, Gone())
try:
    import __spark_entry__
except ImportError:
    sys.exit(7)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 7
