"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert e.__file__.startswith({folder!r}) and "p1_canonicalise" in q and set(o) <= set(q)
print(len(q), sum(n.startswith("op") or n == "pipeline" for n in q), sum(n.startswith("op") for n in o))
"""


def listed(folder, *flags):
    done = subprocess.run([sys.executable, *flags, "-c", SHOW.format(folder=str(folder))], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(n) for n in done.stdout.split()[-3:]]


@pytest.fixture
def copy(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "tests", "corpus_pipeline.py")
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)


def test_without_the_subpackage_the_rest_is_registered(copy):
    total, extra, twins = listed(copy)
    assert total > 80 and extra == twins == 0


def test_a_library_that_is_not_installed_takes_only_the_subpackage_away(copy):
    (copy / "webmill" / "llm").mkdir()
    for name in ("__init__", "queries", "oracles"):
        (copy / "webmill" / "llm" / f"{name}.py").write_text({"queries": "import no_such_library", "oracles": "ORACLES = {'op1_x': 'SELECT 1'}"}.get(name, ""))
    (copy / "corpus_pipeline.py").write_text("from webmill.llm import queries")
    total, extra, twins = listed(copy)
    assert total > 80 and extra == twins == 0
