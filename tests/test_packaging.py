"""The statistics work without the corpus operators, whether those or what they need are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from tallyworks.plans import ORACLES, QUERIES
assert set(e.queries()) == set(QUERIES) | set({extra!r}), set(e.queries()) ^ set(QUERIES)
assert set(QUERIES) & set(e.oracle_sql()) == set(ORACLES)
"""


@pytest.mark.parametrize("hidden, extra", [(["tallyworks.llm", "tallyworks.llm.queries"], []), (["zstandard"], []), (["xxhash"], [])])
def test_entry_without(hidden, extra):
    r = subprocess.run([sys.executable, "-c", PROGRAM.format(hidden=hidden, extra=extra)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr
