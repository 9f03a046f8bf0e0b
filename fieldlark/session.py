"""What a Spark session needs before Python workers run the library's code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the package to Python workers on all machines, once per application.

    Arrow batches get 1,000 rows unless the session says otherwise: rows are
    whole texts here, and a batch is held on both sides of the pipe.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "fieldlark_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)  # Spark's file server hands it out
        _shipped.add(sc.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set (single machine, tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


class Steps:
    """Tables of the steps of a job, written as Parquet in the shared checkpoint folder and read again.

    A reread table has no lineage and the true size of its files. A plan's own
    estimate is the product of its joins' inputs; in a loop its digits double
    each round, checkpoints or not, until planning takes all the time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.paths = spark, f"{checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}", 0, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df as written; the name's former table goes."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, None)
        self.spark.conf.set(clean, "true")  # what was shuffled to write it goes at once
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(clean, before) if before is not None else self.spark.conf.unset(clean)
        if before := self.paths.pop(name, None):
            delete_path(self.spark, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
