"""The library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "roamgrid"), tmp_path / "roamgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()) and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "roamgrid")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, name)).read()
