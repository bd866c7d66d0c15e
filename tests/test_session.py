"""The package reaches workers that do not have it, and an application cleans up after itself."""

import os
import subprocess
import sys
import textwrap
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from sealcheck import session

ROOT = Path(__file__).resolve().parent.parent


def test_query_from_another_folder_leaves_nothing(tmp_path):
    shared = tmp_path / "shared"
    script = textwrap.dedent(f"""
        import sys
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
                 .config("spark.checkpoint.dir", {str(shared)!r}).getOrCreate())
        sys.path.insert(0, {str(ROOT)!r})
        import __spark_entry__ as contract
        print("ROWS", contract.queries()["b05_canonical_json"](spark, "/root/testdata/sf0.001").count())
        from sealcheck.session import cut_lineage
        print("CUT", cut_lineage(spark.range(3)).count())
    """)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=180)
    assert "ROWS 1000" in done.stdout and "CUT 3" in done.stdout, done.stderr[-2000:]
    # The Java side outlives the script for a moment.
    for _ in range(60):
        if not (left := [p for p in shared.rglob("*") if p.is_file()]):
            break
        time.sleep(0.5)
    assert not left


class OnCluster:
    """The test session under the name of a cluster, with a plain path as its shared folder."""

    def __init__(self, spark, shared, application):
        self.real, held = spark, {"spark.checkpoint.dir": shared}
        real = spark.sparkContext
        self.conf = SimpleNamespace(get=lambda key, default=None: held.get(key, default))
        self.folder = None
        self.sparkContext = SimpleNamespace(
            master="spark://host:7077", applicationId=application, defaultParallelism=2, getConf=real.getConf,
            getCheckpointDir=lambda: self.folder, setCheckpointDir=lambda path: setattr(self, "folder", f"{path}/rounds"))

    def __getattr__(self, name):
        return getattr(self.real, name)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_mounted_folder_serves_a_cluster(spark, tmp_path, scheme):
    cluster = OnCluster(spark, f"{scheme}{tmp_path}", f"mounted{scheme}")
    session.ensure_checkpoint_dir(cluster)
    assert cluster.folder == f"{scheme}{tmp_path}/rounds"
    assert session.shared_folder(cluster, "x").startswith(cluster.folder)


def test_a_folder_of_each_machine_is_refused(spark, tmp_path, monkeypatch):
    cluster = OnCluster(spark, str(tmp_path), "apart")
    # What one executor writes to its own disk the others do not find.
    monkeypatch.setattr(session, "written_by_all", lambda spark, folder: False)
    with pytest.raises(RuntimeError, match="for itself"):
        session.ensure_checkpoint_dir(cluster)
    monkeypatch.undo()
    (tmp_path / "file").write_text("x")
    with pytest.raises(RuntimeError, match="cannot write and read"):
        session.ensure_checkpoint_dir(OnCluster(spark, str(tmp_path / "file"), "broken"))
