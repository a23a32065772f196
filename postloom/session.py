"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. Partition counts are left to AQE, which splits and
# merges shuffle partitions by measured size; the cluster's own values win if it sets them.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "postloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session carrying :data:`SESSION_SETTINGS`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_state_store(spark: SparkSession) -> None:
    """Give a session of another origin the state store that stateful operators need; one chosen by its owner stays."""
    chosen = spark.conf.get(STATE_STORE, None)
    if not chosen or chosen.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, SESSION_SETTINGS[STATE_STORE])


_shipped: set[tuple[str, str]] = set()


def ship_packages(spark: SparkSession, *packages: str) -> None:
    """Send packages of this repository to the Python workers, once per application each."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    for package in packages or ("postloom",):
        if (app, package) in _shipped:
            continue
        archive = os.path.join(tempfile.mkdtemp(prefix="postloom-ship-"), f"{package}_bundle.zip")
        with zipfile.ZipFile(archive, "w") as bundle:
            for folder, _, files in os.walk(os.path.join(root, package)):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        bundle.write(path, os.path.relpath(path, root))
        spark.sparkContext.addPyFile(archive)
        _shipped.add((app, package))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared scratch folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only when it is unset and the
    session is local, as in tests, a temporary folder is made and remembered for the session.
    Elsewhere executors would each write to their own disk, so a missing folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="postloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/postloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared scratch folder and read it back.

    Used where a costly result feeds several branches: the written table survives executor
    loss, cuts the lineage, and lets each branch read only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
