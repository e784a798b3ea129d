"""The entry module with and without the corpus package."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def imported(lines):
    code = f"import sys\n{lines}\nimport __spark_entry__ as e\nprint(len(e.queries()) == len(e.QUERIES))"
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "evertally.llm", "evertally.llm.queries"])
def test_the_other_queries_stay_without_the_corpus_package(missing):
    found = imported(f"sys.modules[{missing!r}] = None")
    assert found.returncode == 0, found.stderr
    assert found.stdout.strip() == "True"


def test_other_missing_modules_are_errors():
    found = imported("sys.modules['evertally.operators'] = None")
    assert found.returncode != 0 and "evertally.operators" in found.stderr
