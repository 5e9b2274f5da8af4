"""Session helpers: a tuned SparkSession and the shared work folder.

Stage tables, checkpoints and run state live under the folder the cluster
names in ``spark.checkpoint.dir``; only a ``local`` session may go without.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry") -> SparkSession:
    """A session with AQE on, Arrow on, the UI off and a UTC clock.

    ``master`` and ``shuffle_partitions`` are set only when given (or named in
    QUARRY_MASTER, QUARRY_SHUFFLE_PARTITIONS): a submitted application keeps
    what ``spark-submit`` says, and AQE coalesces the partitions.
    """
    master = master or os.environ.get("QUARRY_MASTER")
    partitions = shuffle_partitions or os.environ.get("QUARRY_SHUFFLE_PARTITIONS")
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if memory := os.environ.get("QUARRY_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", memory)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return sc.getConf().get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir``.

    A cluster session must name one (a machine-local folder is not shared by
    its executors); otherwise this raises. A ``local`` session without one gets
    a scratch folder of its own, set once and removed when Python ends.
    """
    d = _configured(spark)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach "
                "(stage tables and run state are written there)")
        d = tempfile.mkdtemp(prefix="quarry-work-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


@lru_cache(maxsize=1)
def driver_folder() -> str:
    """Where the driver keeps the small files it serves to executors by
    ``addFile``; they must stay until the application ends."""
    d = tempfile.mkdtemp(prefix="quarry-serve-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of every executor,
    also of those that join later (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(driver_folder(), f"quarry-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{work_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes every table this application has put into the shared folder;
    call it when no DataFrame built on them is needed any more."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/quarry-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table", compact: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it as a parquet table in the shared
    folder (``spark.checkpoint.dir``) and read it back. A lost executor
    re-reads the table instead of re-running the work before it.

    ``compact`` is for slim results of a wide scan, which would leave a small file for
    every split of the input: their rows are dealt anew to files of the advisory size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.hint("rebalance") if compact else df).write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
