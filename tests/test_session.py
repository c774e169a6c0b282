"""Session helpers: shared folder, scratch tables, package on the executors."""

import os
import subprocess
import sys
import tempfile

import pytest

from telewatch import session


def test_only_local_masters_get_a_private_folder():
    assert session.is_local("local") and session.is_local("local[8]")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_tables_are_dropped():
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(session.__file__))!r})
from telewatch.session import build_session, drop_scratch
from telewatch.operators.ordered import materialize
import os
spark = build_session("local[2]")
df = materialize(spark.range(10))
root = os.path.dirname(df.inputFiles()[0]).replace("file://", "")
assert os.path.isdir(root)
drop_scratch(spark)
assert not os.path.isdir(root)
# workers import the package although they run in another folder
import telewatch.functions.timefn as m
assert spark.sparkContext.parallelize([1]).map(lambda x: m.__name__).collect() == ["telewatch.functions.timefn"]
"""
    subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), check=True, timeout=120,
                   env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
