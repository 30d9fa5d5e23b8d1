"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
_local_dirs: dict[str, str] = {}

# Runtime SQL settings every plan relies on. Cluster sizing stays with the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, name: str = "tidemark") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        # Call-site capture costs more than building these plans does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach. Only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # The setting cannot be changed in a running session; one folder serves the whole application.
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_dirs[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, in the innermost open scope of this thread."""
    scopes = getattr(_open, "scopes", None)
    parent = scopes[-1] if scopes else (
        f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    return f"{parent}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging_scope(spark: SparkSession):
    """Tables staged inside are removed when the block ends; write the results before that."""
    path = fresh_path(spark, "scope")
    _open.scopes = [*getattr(_open, "scopes", []), path]
    try:
        yield path
    finally:
        _open.scopes = _open.scopes[:-1]
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_days_after(spark: SparkSession, path: str, last: date | None) -> None:
    """Delete the `day=` folders of days after `last`, all of them if there is none; those of a table that
    is kept by day and was not brought to its end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("day=") and (last is None or name[4:] > last.isoformat()):
                remove(spark, status.getPath().toString())


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    A report reads its roll-up a dozen times. A written table survives executor loss without
    re-reading the facts, and its file sizes let Catalyst choose broadcast joins by real size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
