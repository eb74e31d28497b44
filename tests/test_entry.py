import subprocess
import sys

import __spark_entry__


def test_names_and_sql():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_llm_folder(tmp_path):
    import pathlib
    import shutil

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_ranked' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
