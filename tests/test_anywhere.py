"""Jobs with Python workers run from any folder: the session ships the package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from scorelattice.session import local_session
spark = local_session(4)
for name in ("json_records", "html_tables", "stream_fold"):
    print(name, entry.queries()[name](spark, {folder!r}).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data")
def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, folder=FOLDER)
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.split() == ["json_records", "True", "html_tables", "True", "stream_fold", "True"], out.stderr[-2000:]
