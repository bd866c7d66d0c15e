"""Session defaults, code on the workers, and reliable checkpointing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ranks are cut in each task before the shuffle for any limit in use, not only up to 1000 rows a group.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
    # What a finished query has shuffled goes at once, not when the driver's memory is next cleaned.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Ids are hex digests, which the default codec leaves at their full length.
CODEC = "zstd"


_SHIPPED: set[str] = set()
_CLEANED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sealcheck-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := f"{folder}/sealcheck.zip", "w", zipfile.ZIP_DEFLATED) as file:
        for module in sorted(root.rglob("*.py")):
            file.write(module, module.relative_to(root.parent).as_posix())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes; leaves sizing to the cluster."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    A plain path may be a folder every machine mounts, so it is tried once per application rather than judged by its
    name. Only where nothing is named and everything runs on this machine, a temporary folder takes its place. What
    an application writes there is deleted when it ends.
    """
    context = spark.sparkContext
    if context.applicationId in _CLEANED:
        return
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    local = context.master.startswith("local")
    mounted = shared.startswith("file:") or "://" not in shared and not _default_is_shared(spark)
    if not shared and not local:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sealcheck-checkpoint-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(path)
    atexit.register(_forget, store, path)
    if shared and not local and mounted:
        try:
            found = written_by_all(spark, path.toString())
        except (PySparkException, Py4JJavaError) as error:
            raise RuntimeError(f"spark.checkpoint.dir is {shared}, which tasks cannot write and read") from error
        if not found:
            raise RuntimeError(f"spark.checkpoint.dir is {shared}, which each machine of a cluster has for itself")
    _CLEANED.add(context.applicationId)


def _forget(store, path) -> None:
    """Delete an application's rounds; a session that has ended already did so itself."""
    with contextlib.suppress(Exception):
        store.delete(path, True)


def written_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether all rows that tasks write below a folder are found again by the driver and by other tasks; a few rows per core."""
    rows = 2 * max(spark.sparkContext.defaultParallelism, 1)
    path = f"{folder}/probe-{uuid4().hex}"
    spark.range(0, rows, 1, rows).write.parquet(path)
    return spark.read.schema("id long").parquet(path).count() == rows


def _default_is_shared(spark: SparkSession) -> bool:
    return not (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    A lost executor then never replays earlier rounds, and later reads take only the columns they need. The
    frame is computed once.
    """
    path = shared_folder(frame.sparkSession, "cut")
    frame.write.parquet(path, compression=CODEC)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
