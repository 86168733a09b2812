"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.fixture
def copy(tmp_path):
    """The package and the entry module, without the subpackage and its pipeline."""
    shutil.copytree(f"{ROOT}/lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    return tmp_path


def run(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage(copy):
    from lectern.plans import registry

    for caches_left in (False, True):
        if caches_left:
            (copy / "lectern/llm/__pycache__").mkdir(parents=True)
        out = run(copy)
        assert out.returncode == 0, out.stderr
        assert out.stdout.split() == [str(len(registry.queries())), str(len(registry.oracles())), "0"]


def test_a_broken_subpackage_raises(copy):
    (copy / "lectern/llm").mkdir()
    (copy / "lectern/llm/__init__.py").write_text("")
    (copy / "lectern/llm/queries.py").write_text("import no_such_module_at_all\n")
    (copy / "corpus_pipeline.py").write_text("")
    out = run(copy)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/lectern"):
        if f"{os.sep}llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in {w for line in open(f"{folder}/{f}", encoding="utf-8") if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()}, f
