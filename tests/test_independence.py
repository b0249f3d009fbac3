"""The library works without the text operators' subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_it():
    sub = "reviewloom." + "llm"
    for p in (ROOT / "reviewloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "reviewloom").parts:
            assert sub not in p.read_text(), p


def test_entry_without_it():
    code = "import sys; sys.modules['reviewloom.' + 'llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_executors_need_no_path(tmp_path):
    """From another folder, without PYTHONPATH."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e; assert e.queries()['name_similarity'](s, '/root/testdata/sf0.001').count() > 0"
    )
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(ROOT)], check=True, cwd=tmp_path, env=env, capture_output=True, timeout=300)
