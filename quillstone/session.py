"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, cores: int = 8, shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings all results are defined under: UTC, ANSI, adaptive plans.

    On a cluster the master and the sizes come from spark-submit; only settings that change results or let the
    adaptive planner work are fixed here.
    """
    b = SparkSession.builder.appName("quillstone")
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        b = b.config(k, v)
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a folder of this machine, which only a local master can do with; any other raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(scratch_dir, "own", None)
        if not found:
            found = scratch_dir.own = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut of the lineage that outlives lost executors.

    Parquet rather than checkpoint(): it is compressed and keeps column pruning. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillstone-{os.getpid()}-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is still there."""
    if path.startswith("file:/"):
        shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone: the folder's owner cleans up
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that no machine needs it installed."""
    sc = spark.sparkContext
    if getattr(ship, "done", None) == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillstone-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = shutil.make_archive(os.path.join(folder, "quillstone_package"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(path)
    ship.done = sc.applicationId
