import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from moodtide.session import local_session
import __spark_entry__ as contract
spark = local_session(2)
for name in ("model_sentiment", "page_links"):
    print(name, contract.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_installed_package(tmp_path):
    """Python workers start elsewhere and cannot import the package by its path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "model_sentiment 200" in run.stdout and "page_links 279" in run.stdout, run.stderr[-2000:]
