"""Session defaults and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_KNOWN: set[str] = set()


def build_session(app: str = "webwarden", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; cluster settings win where they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or that the session's context was given. Only where none is set and
    the master is this very process (tests, one machine) a temporary one is made; a cluster without one is an error,
    since its executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master} is not one machine")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        folder = tempfile.mkdtemp(prefix="webwarden-")
        _LOCAL_DIR[app] = "file://" + folder
        pid = os.getpid()
        atexit.register(lambda: os.getpid() == pid and shutil.rmtree(folder, ignore_errors=True))
    return _LOCAL_DIR[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; silent when it is gone already or the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        return


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are: a folder of its own, so that those of a driver that died can be
    told and removed."""
    return f"{shared_dir(spark)}/webwarden/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, nothing is recomputed, and the
    files outlive any executor. They are removed by `release`, or when the driver process ends."""
    spark = df.sparkSession
    folder = tables_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        pid = os.getpid()
        atexit.register(lambda: os.getpid() == pid and remove_path(spark, folder))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once the results that read them have been written: what a
    session that runs many queries calls in between."""
    remove_path(spark, tables_dir(spark))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in bytes: a number for sizing partitions, never a switch between results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of a plan below which its rows are too few to be worth dealing out.
SPREAD_FROM = 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """A scan that has work for less than half of the cores, such as one small file, dealt out over all of them. Larger
    scans, which have a partition for each part of their files, stay as they are: there is no shuffle to pay for."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < SPREAD_FROM or 2 * df._jdf.queryExecution().toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores)
