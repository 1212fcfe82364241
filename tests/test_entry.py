"""The entry point, with and without what is optional."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["nothing", "xxhash", "corpus_pipeline", "tabulith.llm"])
def test_table_queries_need_no_optional_module(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len(e.queries()), 'g1_jsd' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) >= 100 and out[1:] == ["True", "True"]
