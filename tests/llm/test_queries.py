"""The registered queries on the smallest table: against their SQL, or that they run."""

import subprocess
import sys
from pathlib import Path

import pytest

from oracle import compare, duck
from rankmill.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_the_smallest_table(spark, small, name):
    ok, note = compare(spark, duck(small), name, QUERIES[name], ORACLES.get(name), small)
    assert ok, note


@pytest.mark.parametrize("name", ["op2_mixing", "op8_url_lists"])
def test_native_plans_have_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_the_library_does_not_import_the_package():
    root = Path(__file__).resolve().parents[2]
    code = "import sys, rankmill.catalog; sys.exit(any(m.startswith('rankmill.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """From another folder, so that Python workers can't import the package."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from rankmill.llm.queries import QUERIES
from rankmill.session import build_session
spark = build_session("local[2]", spark__sql__shuffle__partitions="2", spark__driver__memory="2g")
for name in ("op3_language", "op7_language_model", "op9_decontamination"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
