"""The entry offers the panel's queries whatever else is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "topk_query" in names and "stream_dedup" in names and not any(n.startswith("op1") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def run(missing):
    return subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True)


@pytest.mark.parametrize("missing", ["panelyard.llm", "corpus_pipeline", "regex", "xxhash", "public_tokenizers"])
def test_what_only_the_subpackage_needs_may_be_missing(missing):
    done = run(missing)
    if missing not in ("panelyard.llm", "corpus_pipeline") and not (ROOT / "panelyard" / "llm").exists():
        pytest.skip("the subpackage is left out")
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("missing", ["panelyard.operators.ranks", "panelyard.queries.seasons"])
def test_what_the_panel_needs_may_not(missing):
    assert run(missing).returncode != 0
