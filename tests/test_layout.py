"""The library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q))"


def shown(path):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_the_rest_stands_alone(tmp_path):
    """With both folders and the pipeline gone, or a library missing that only they need, the other queries are there."""
    for name in ("longspan", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    queries, sql, training = shown(str(tmp_path))
    assert int(queries) > 70 and int(sql) > 60 and training == "False"


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "longspan")):
        if os.sep + "llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    assert "longspan.llm" not in open(os.path.join(folder, name)).read()
