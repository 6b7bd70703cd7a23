"""Session and table access shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shoebox")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_TOPS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The one folder that this application owns where the cluster shares files (spark.checkpoint.dir); close() deletes it.

    Only a local session may leave that setting empty, as tests do: a temporary folder then serves, remembered here,
    since Spark lets nobody set the key of a running session. Elsewhere each executor would write to a disk of its own,
    so that is an error.
    """
    app, top = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not top and app not in _LOCAL_TOPS:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _LOCAL_TOPS[app] = tempfile.mkdtemp(prefix="spark-")
    return f"{(top or _LOCAL_TOPS[app]).rstrip('/')}/shoebox-{app}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below shared_root()."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir() named."""
    p, files = hadoop(spark, path)
    files.delete(p, True)


def close(spark: SparkSession) -> None:
    """Deletes all that queries of this application left in the shared folder. Results that were not read yet are lost;
    call it when the last is."""
    remove(spark, shared_root(spark))
    if top := _LOCAL_TOPS.pop(spark.sparkContext.applicationId, None):
        remove(spark, top)
