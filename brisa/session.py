"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: int = 8, shuffle_partitions: int | None = None, app: str = "brisa", shared: str | None = None
) -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own.

    ``shared`` is the folder for stored tables and checkpoints, a new one by default.

    Looking up the Python call site of every column expression takes longer than
    planning a small query, so that debugging aid is off.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan here relies on: calendar fields are UTC fields."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executor are one process, may fall back to a folder
    of its own; on a cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_DIRS[application]


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten or cleared."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage with reliable checkpoints."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
