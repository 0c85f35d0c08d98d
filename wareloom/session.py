"""Session helpers: builder for local use, checkpoint folder policy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Work folders made, by application.
_WORK: dict[str, list[str]] = {}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wareloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only a local session without one gets a temporary folder: on a cluster
    a machine-local folder would be lost with the machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wareloom-checkpoint-"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _WORK.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_work(spark: SparkSession) -> int:
    """Delete the work folders that this application has made; how many there were.

    For a caller that has written its results elsewhere: DataFrames that still
    read a staged table, and streams that are to go on, lose their files.
    """
    folders = _WORK.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        files, path = hadoop_path(spark, folder)
        files.delete(path, True)
    return len(folders)


def hadoop_path(spark: SparkSession, folder: str):
    """(file system, path) in Hadoop's terms, so any store that Spark reads will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: several readers, one computation.

    Unlike a cache it survives lost executors, and readers prune columns.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
