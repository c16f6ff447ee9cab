"""The entry module works with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_operators():
    code = "import sys; sys.modules['tallylog.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_them():
    for path in (REPO / "tallylog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallylog.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
