"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: spark.checkpoint.dir, or what setCheckpointDir was told. Where neither is
    set, a temporary folder of this machine if Spark runs on it alone, else the home folder of the default file system if
    that is a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    told = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root or told.isDefined():
        return (root or told.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        system = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
        if system.getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{system.getHomeDirectory().toString()}/siltstone-scratch"
    else:
        folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    spark.sparkContext.setCheckpointDir(root)  # a later call finds it there; spark.checkpoint.dir cannot be set once Spark runs
    return root


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Deletes all tables this process has written; what reads them cannot be run again."""
    while _MADE:
        _delete(spark, _MADE.pop())


#: Deletes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage; any executor can read them again. What was shuffled to write one is deleted once
    it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _MADE.append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)

    def clear(self) -> None:
        """Deletes all its tables; for when all that reads them is written."""
        _delete(self.spark, self.base)
