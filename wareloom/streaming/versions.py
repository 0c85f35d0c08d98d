"""A table in buckets, each with versions named by the batch that wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    files, path = hadoop_path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


class BucketedVersions:
    """Rows in folder/bucket=<n>/version=<batch id>.

    A bucket's rows as of a batch are those of its newest version up to that
    batch; buckets that a batch leaves alone keep theirs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self, bucket: int | str) -> list[int]:
        names = children(self.spark, f"{self.folder}/bucket={bucket}")
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))

    def read(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows as of a batch, of these buckets or all; None if there are none yet.

        Only the folders of these versions are listed and read.
        """
        if buckets is None:
            buckets = [n.partition("=")[2] for n in children(self.spark, self.folder) if n.startswith("bucket=")]
        paths = []
        for bucket in buckets:
            old = [v for v in self.versions(bucket) if v <= batch_id]
            if old:
                paths.append(f"{self.folder}/bucket={bucket}/version={old[-1]}")
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows with a `bucket`, as a new version of the buckets that they have; others are not touched."""
        versioned = rows.withColumn("version", F.lit(batch_id)).repartition("bucket")
        versioned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.folder)

    def forget(self, batch_id: int, buckets: list[int], keep: int = 2) -> None:
        """Drop all but the newest `keep` versions up to a batch of these buckets."""
        for bucket in buckets:
            for version in [v for v in self.versions(bucket) if v <= batch_id][:-keep]:
                files, path = hadoop_path(self.spark, f"{self.folder}/bucket={bucket}/version={version}")
                files.delete(path, True)
