"""Session helpers shared by every layer of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, name: str = "frameloom") -> SparkSession:
    """A single-node session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Folders made for local sessions that name none, by application.
_MADE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset in a local session, as in tests, a temporary folder is made; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _MADE:  # the setting itself cannot be changed in a running session
            _MADE[app] = tempfile.mkdtemp(prefix="frameloom-")
        found = _MADE[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in this application's part of it."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/frameloom/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has staged; results that were not written or collected yet are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write df once as a table in the shared folder and read that back.

    A lost executor then costs only the tasks that read the table, never the work before it. A small
    result of many tasks is dealt to a few files first, which spares the store and the readers. The table
    stays until `clear_scratch`.
    """
    spark = df.sparkSession
    if small:
        df = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
