"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes; the operators of a larger stage are generated one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows may hold long texts; a smaller batch bounds what a Python worker and its task hold at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(app_name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Sets what the operators rely on in a session that somebody else has built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The working folders of this process by application, until they are released.
_FOLDERS: dict[str, list[str]] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, under the folder named by ``spark.checkpoint.dir``.

    On a cluster that folder is shared storage, so a lost executor loses no
    data.  Only a local master may fall back to a temporary folder; anywhere
    else a missing setting is an error.  The folder stays until
    ``release_work_folders``, as results are read from it when they are asked for.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if shared:
        folder = f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix=f"tidewell-{purpose}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release_work_folders(spark: SparkSession, keep: int = 0) -> int:
    """Removes the application's working folders but the newest ``keep``; how many there were.

    For the caller who has written or collected all results that were read from them.
    """
    folders = _FOLDERS.get(spark.sparkContext.applicationId, [])
    old = folders[: len(folders) - keep] if keep else list(folders)
    for folder in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        folders.remove(folder)
    return len(old)
