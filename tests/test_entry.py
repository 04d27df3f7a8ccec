"""The driver's contract holds with and without the llm subpackage."""

import subprocess
import sys

from .conftest import ROOT

WITHOUT = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "ledgerloom.llm") or name.startswith("ledgerloom.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_imports_without_llm():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert {"table_name", "field", "examined", "null_count", "distinct_count", "basis"} <= set(df.columns)
    assert df.count() == 5 + 6 + 11
    assert set(e.oracle_sql()) <= set(e.queries())
