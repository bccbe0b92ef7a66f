"""Catalog queries against their SQL on the smallest tables.

``PLUMBLINE_ALL=1`` runs every query; by default a spread over all families is run.
"""

from __future__ import annotations

import os

import pytest

from plumbline.catalog.all import REGISTRY
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
DEFAULT = [
    "size_profile", "fingerprint", "doc_lint", "co_change", "duplicate_scores", "resolve_path", "longest_prefix_map", "instability",
    "validate_records", "drift", "ground_quotes", "manifest_diff", "warrant", "read_changes", "stream_churn", "stream_intake",
    "candidate_pairs_copies", "cohesion", "longest_common_run", "usage_by_text", "write_sarif", "layer_breaches_circular",
]
NAMES = sorted(REGISTRY) if os.environ.get("PLUMBLINE_ALL") else DEFAULT

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, FOLDER)
    if q.sql is None:
        df.count()
        return
    assert [p for p in compare(df, con, q.sql) if p != "no rows"] == []


def test_entry_contract():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(REGISTRY) <= names and set(entry.oracle_sql()) <= names
    # Beyond the catalog only the training-data queries, and only where their package is present.
    assert names - set(REGISTRY) == set(entry.TRAINING)


def test_entry_without_the_training_package(monkeypatch):
    import importlib
    import sys

    for gone in (["plumbline.llm"], ["corpus_pipeline"], ["plumbline.llm", "corpus_pipeline"]):
        with monkeypatch.context() as m:
            for name in list(sys.modules):
                if name in ("__spark_entry__", "corpus_pipeline") or name.startswith("plumbline.llm"):
                    m.delitem(sys.modules, name)
            for name in gone:
                m.setitem(sys.modules, name, None)
            entry = importlib.import_module("__spark_entry__")
            assert set(entry.queries()) == set(REGISTRY)
