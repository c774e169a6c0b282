"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package assumes. Adaptive execution re-plans joins
# and coalesces shuffle output at runtime; skew-join splitting keeps a hot
# system_id from stalling one reducer; UTC keeps timestamps comparable.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "telewatch",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is; without it nothing may be written, since every executor would write
    to its own disk, so an error is raised.  Only in local mode (tests) is a
    private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="telewatch-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(master: str) -> bool:
    """One process runs everything (``local`` or ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def prepare(spark: SparkSession) -> SparkSession:
    """What every job needs on its session: the shared folder, and this
    package on the executors when they are other processes elsewhere."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers (once per application), so jobs
    do not depend on the working folder or on an installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="telewatch-lib-")), "telewatch.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)


def _scratch_root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"telewatch-{spark.sparkContext.applicationId}")


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A folder of this application under the shared checkpoint location."""
    return os.path.join(_scratch_root(spark), name)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each query ends, not when
    the driver's garbage collector finds them.  For queries whose plan is run
    once, as that of a written table is."""
    with conf_set(spark, SHUFFLE_CLEANUP, "true"):
        yield


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def conf_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for the queries run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the written tables of this application (when no DataFrame that
    reads them is needed any more)."""
    drop_table(spark, _scratch_root(spark))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table of this application, or a folder of them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
