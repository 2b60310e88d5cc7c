"""The entry module lists its queries without a session."""

import subprocess
import sys
from pathlib import Path


def test_lists_queries():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
