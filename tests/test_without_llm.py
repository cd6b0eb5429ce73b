"""The library without the optional training-data parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True)


def test_nothing_outside_imports_the_optional_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "lanternfish")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "lanternfish.llm" not in open(os.path.join(folder, name), encoding="utf-8").read()
