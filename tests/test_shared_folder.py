"""Queries where Spark's configuration is empty: the shared folder is the session's own, and nothing stays after close()."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import glob, os, sys, tempfile
sys.path.insert(0, os.environ["REPO"])
from shoebox.session import close, local_session, shared_root
import __spark_entry__ as entry
spark = local_session("4", 4)
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name, query in entry.queries().items():
    if (name.startswith("op") or name == "pipeline") == ("text" in sys.argv):
        query(spark, os.environ["SMALL"]).write.format("noop").mode("overwrite").save()
root = shared_root(spark)
assert os.path.isdir(root), root
close(spark)
assert not os.path.exists(os.path.dirname(root))
print("whole")
"""


def run(tmp_path, *args):
    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "REPO": REPO, "SMALL": os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), "PYTHONPATH": REPO}
    return subprocess.run([sys.executable, "-c", RUN, *args], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=1500)


def test_queries_without_a_checkpoint_folder(tmp_path):
    done = run(tmp_path)
    assert done.stdout.strip().endswith("whole"), done.stderr[-3000:]
