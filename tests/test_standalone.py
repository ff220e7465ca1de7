"""The engine without its subpackage for training data."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "quarry")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", file.read(), re.M), name


def test_entry_without_it():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quarry.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "q14_top" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
