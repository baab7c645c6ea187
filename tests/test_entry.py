"""The driver contract: what is registered, and what happens without the optional part."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys
from importlib.abc import MetaPathFinder

class Hidden(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {package!r} or name == {package!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(len(entry.queries()), sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit()))
"""


@pytest.mark.parametrize("package", ["scorecraft.llm", "corpus_pipeline", "public_tokenizers", "regex", "xxhash"])
def test_core_queries_without_a_package_of_the_optional_part(package):
    run = subprocess.run(
        [sys.executable, "-c", HIDDEN.format(package=package)], cwd=ROOT, capture_output=True, text=True, timeout=120
    )
    assert run.returncode == 0, run.stderr
    from scorecraft.plans import catalog

    count, names = run.stdout.split(" ", 1)
    assert int(count) >= len(catalog.REGISTRY)
    if "not registered" in run.stderr:
        assert int(count) == len(catalog.REGISTRY) and names.strip() == "[]"


def test_every_core_query_has_sql():
    from scorecraft.plans import catalog, oracle

    assert set(oracle.SQL) == set(catalog.REGISTRY)
