"""Session defaults, the shared work folder and shipping of this package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "logwarden", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing and skew splitting) and UTC time."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers import functions by module name; without this they find the package only
    when it is installed on every machine or the job was started from its folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "logwarden.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


# Rows of costly text work that one task takes.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, *keys: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deals rows out over all cores and over more tasks as they grow, some ``rows`` to each.

    For text work that costs far more than moving the rows. Splits of a file say little: a few large row groups leave
    most of them empty. Hash partitioning by ``keys`` gives the same rows again on a retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one machine
    (``local``) may go without: a temporary folder is made and recorded there. Anywhere
    else a missing setting is an error, because executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_work_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where an intermediate is read more than once and is costly to derive:
    the written files survive the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = new_work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    folder = work_folder(spark).rstrip("/")
    jvm = spark._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        if name.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
