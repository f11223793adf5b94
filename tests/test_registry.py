"""Every registered query beside its oracle SQL, none of them empty; the entry file with and without the training-data folders."""
from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from hiresift.plans import registry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
KEYS = sorted(registry.queries())
#: nothing in the smallest tables repeats itself so
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_its_query():
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, duck, key):
    ok, note = compare(spark, duck, SF, key, registry.queries()[key], registry.oracles().get(key))
    assert ok, note
    assert key in MAY_BE_EMPTY or not note.startswith("rows=0 "), "the query gives no row"


def test_the_entry_works_without_the_training_data_folders(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "hiresift", tmp_path / "hiresift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    assert out.stdout.split() == [str(len(KEYS)), "0", "False", "True"]
