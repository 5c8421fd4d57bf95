"""Every query of the library's own operators against its oracle, on the whole tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, oracle_connection
from evalspark.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, oracle, name):
    assert difference(QUERIES[name](spark, SF_DIR), oracle, ORACLES[name]) is None


def test_entry(spark):
    result = entry(spark)
    assert result.count() > 0
    assert result.columns[:2] == ["llm_provider_name", "configured_llm_name"]


def test_all_own_queries_are_registered():
    assert QUERIES.keys() <= queries().keys()
    assert ORACLES.items() <= oracle_sql().items()
    assert oracle_sql().keys() <= queries().keys()


def test_the_rest_works_without_the_training_text_part(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    run = subprocess.run(
        [sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True
    )
    assert run.stdout.strip() == str(len(QUERIES)), run.stderr
