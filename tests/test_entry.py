"""The driver's module must import, and list its queries, without a session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) >= 65 and callable(e.entry)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True).returncode == 0
