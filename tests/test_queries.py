"""Every registered query against its SQL, and without SQL that it runs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from topicgauge.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, con, name):
    df = contract.queries()[name](spark, folder)
    rows = df.collect()
    assert rows
    if name in catalog.SQL:
        assert differences(rows, df.columns, con, catalog.SQL[name]) is None


def test_cells_reach_their_recall(spark, folder):
    found = catalog.QUERIES["knn_cells_recall"](spark, folder).agg({"hits": "sum", "wanted": "sum"}).first()
    assert found["sum(hits)"] >= 0.9 * found["sum(wanted)"] > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_contract_without_the_optional_parts(tmp_path):
    """The contract still imports where the training-data folders are gone, with or without the pipeline's file."""
    code = "import __spark_entry__ as c; assert 'drift_detect' in c.queries(); assert 'pipeline' not in c.queries()"
    for name in ("with_pipeline", "without_pipeline"):
        copy = tmp_path / name
        shutil.copytree(ROOT / "topicgauge", copy / "topicgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(ROOT / "__spark_entry__.py", copy)
        if name == "with_pipeline" and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", copy)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=60)
