"""Every query of the panel library against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, connect

OWN = {k: f for m in entry.MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry.MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(con, OWN[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert OWN[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["model", "n", "mae", "rmse", "r2", "dir_acc"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_hides_no_broken_import(tmp_path):
    """Without the optional folders the entry still imports; with a broken one it does not."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "vintagepanel"), tmp_path / "vintagepanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    ask = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(ask().stdout.split()[-1]) == len(OWN)
    (tmp_path / "vintagepanel" / "llm").mkdir()
    (tmp_path / "vintagepanel" / "llm" / "__init__.py").write_text("")
    (tmp_path / "vintagepanel" / "llm" / "queries.py").write_text("import vintagepanel.llm.no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert ask().returncode != 0
    # what the optional part needs of others may be missing: the panel queries stay
    (tmp_path / "vintagepanel" / "llm" / "queries.py").write_text("import no_such_library")
    lacking = ask()
    assert int(lacking.stdout.split()[-1]) == len(OWN) and "no_such_library" in lacking.stderr
