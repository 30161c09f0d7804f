"""Session helpers: build a session for local runs and find the shared scratch folder.

Library functions never create sessions; they take DataFrames. These helpers are
for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: adaptive execution re-plans joins and coalesces
# small shuffle partitions at runtime, and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "spanlake", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the application's checkpoint folder: the one given to
    ``setCheckpointDir`` or named by ``spark.checkpoint.dir``. Only a local master,
    whose executors are the driver's own threads, gets a private folder if there is
    none; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("no shared folder: set spark.checkpoint.dir or call setCheckpointDir")
            path = tempfile.mkdtemp(prefix="spanlake-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/spanlake-scratch/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_fs_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def path_exists(path: str) -> bool:
    return os.path.exists(local_fs_path(path)) if is_local_path(path) else True


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``spanlake`` package importable in Python workers.

    Needed by the ``mapInArrow`` scorer path: its functions are pickled by
    reference. The package is zipped once per application into the shared
    checkpoint folder and added with ``addPyFile``. When that folder is not a
    local path (a cluster file system), the package is expected to be installed
    on the executors or passed with ``--py-files``.
    """
    import zipfile

    import spanlake

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    if not is_local_path(base):
        _SHIPPED.add(sc.applicationId)
        return
    pkg = os.path.dirname(os.path.abspath(spanlake.__file__))
    root = os.path.dirname(pkg)
    out_dir = os.path.join(local_fs_path(base), "spanlake-pyfiles", sc.applicationId)
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, "spanlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
