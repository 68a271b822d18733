"""The driver contract, also where the training-data packages can't be imported."""

import subprocess
import sys

import pytest

from conftest import ROOT
from motionlake.plans import catalog

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""


@pytest.mark.parametrize("absent", ["regex", "motionlake.llm"])
def test_motion_queries_stay_without_the_rest(absent):
    """A library that only the training-data operators need, or these operators themselves."""
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(absent)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= len(catalog.QUERIES) and int(out[-1]) >= len(catalog.ORACLE_SQL)
