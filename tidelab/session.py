"""Session helpers.

The library never creates machine-local scratch space behind the user's back: anything that must
survive an executor loss (checkpoints, round-trip files, logs) goes under the shared folder the
cluster names in ``spark.checkpoint.dir``. Only when that setting is missing (local tests) do we
create one, and only for a local master.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


#: Scratch folders by application, and the applications that have this package on their executors.
_scratch: dict[str, list[str]] = {}
_shipped: set[str] = set()


def get_session(master: str | None = None, app: str = "tidelab", **conf: str) -> SparkSession:
    """Return the active session or build one with sane defaults (AQE on, UTC, no UI)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None and not conf:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint dir; set a local one only when none is configured."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext; the server owns the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must be set on a Spark Connect server") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not str(sc.master).startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidelab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it even
    where the repository is not on the workers' path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidelab-ship-"), "tidelab_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique (not yet existing) path under the shared checkpoint directory, deleted by
    ``release_scratch`` or when the driver ends."""
    base = ensure_checkpoint_dir(spark)
    path = base.rstrip("/") + f"/tidelab-{name}-{uuid.uuid4().hex[:12]}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def release_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder made so far for this application; returns how many. Frames that
    read from them can no longer be evaluated."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        release_scratch(spark)
    except Exception:  # noqa: BLE001 - the context is already gone; nothing is left to delete with
        return


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint folder and reading it
    back. Survives executor loss like ``checkpoint()``, reads columnar (pruned, with file-size
    statistics for the planner) when the frame is used several times."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
