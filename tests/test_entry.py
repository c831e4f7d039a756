"""The driver's module stands without the training-data operators, and hides no fault of theirs."""

import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(absent):
    """A fresh interpreter's import while a module can't be found."""
    code = f"import sys; sys.modules['{absent}'] = None\nimport __spark_entry__ as e\nfrom driftwood.plans import catalog\nassert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)


@pytest.mark.parametrize("absent", ["corpus_pipeline", "driftwood.llm"])
def test_without_llm(absent):
    run = imported(absent)
    assert run.returncode == 0, run.stderr


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is absent")
def test_fault_is_told():
    run = imported("zlib")
    assert run.returncode != 0 and "zlib" in run.stderr
