"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is
    unset and all runs in one process (tests): elsewhere executors wouldn't see it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def _delete(jvm, path: str) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


def _delete_quietly(jvm, path: str) -> None:
    try:
        _delete(jvm, path)
    except Exception:  # the gateway has gone before us: the folder's owner cleans up
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that nobody holds any more: it does so
    when they are collected, which a driver with memory to spare puts off.  The JVM
    hears of dropped references up to a second later, so it is asked after that,
    while the next job runs."""
    gc.collect()
    later = threading.Timer(1.5, _collect, [spark.sparkContext._jvm])
    later.daemon = True
    later.start()


def _collect(jvm) -> None:
    try:
        jvm.java.lang.System.gc()
    except Exception:  # the session has ended meanwhile
        pass


class Stage:
    """Tables written to the shared folder in one job each: they cut lineage, survive
    lost executors, and can be dropped as soon as nothing reads them.  What a lazy
    result may still read goes when the program ends."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy  # tidy: release shuffle files before each job
        self.root = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete_quietly, spark.sparkContext._jvm, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write once and return a reader of the written table."""
        if self.tidy:
            release(self.spark)
        path = self.path(name)
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables of this stage; a missing one is no error."""
        for name in names:
            _delete(self.spark.sparkContext._jvm, self.path(name))
