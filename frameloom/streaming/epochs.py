"""A log of training epochs kept by a stream: what each epoch gave, the best so far, and when to stop.

Each micro-batch is written under its number, the log rows and what is known of every run after it, and reads what
was known after the one before. A batch that is repeated after a failure overwrites its own folders with the same rows, so
it adds nothing. Epochs of a run arrive in order across micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is known of every run after a micro-batch.
KNOWN = "best double, best_epoch long, last_epoch long, stopped boolean"


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches below a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(where) if fs.exists(where) else []
    names = [f.getPath().getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def known(spark: SparkSession, path: str, run: str, run_type: str, before: int | None = None) -> DataFrame:
    """(run, best, best_epoch, last_epoch, stopped) after the last micro-batch, or the last before a number."""
    numbers = [n for n in batches(spark, f"{path}/known") if before is None or n < before]
    schema = f"`{run}` {run_type}, {KNOWN}"
    return spark.read.schema(schema).parquet(f"{path}/known/batch={numbers[-1]}") if numbers else spark.createDataFrame([], schema)


def epoch_sink(path: str, run: str, epoch: str, value: str, patience: int) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: log rows with best, epochs_since_best and stopped, the columns of `sequence.early_stop`."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[run].dataType.simpleString()
        before = known(spark, path, run, kind, number)
        order = Window.partitionBy(run).orderBy(epoch)
        earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
        rows = batch.join(before.select(run, *(F.col(c).alias(f"_{c}") for c in ("best", "best_epoch", "last_epoch", "stopped"))), run, "left")
        rows = rows.where(F.col("_last_epoch").isNull() | (F.col(epoch) > F.col("_last_epoch")))
        rows = rows.withColumn("_at", F.when(F.coalesce(F.col(value) > F.greatest("_best", F.max(value).over(earlier)), F.lit(True)), F.col(epoch)))
        rows = rows.withColumn("best", F.greatest("_best", F.max(value).over(so_far))).withColumn("_best_epoch", F.coalesce(F.max("_at").over(so_far), F.col("_best_epoch")))
        rows = rows.withColumn("epochs_since_best", F.col(epoch) - F.col("_best_epoch"))
        ran_out = F.max((F.col("epochs_since_best") >= patience).cast("int")).over(so_far) == 1
        rows = rows.withColumn("stopped", ran_out | F.coalesce("_stopped", F.lit(False)))
        log = f"{path}/log/batch={number}"
        rows.select(*batch.columns, "best", "epochs_since_best", "stopped", F.col("_best_epoch").alias("best_epoch")).write.mode("overwrite").parquet(log)
        last = spark.read.parquet(log).groupBy(run).agg(F.max_by(F.struct(F.col("best").cast("double").alias("best"), F.col("best_epoch").cast("long").alias("best_epoch"), F.col(epoch).cast("long").alias("last_epoch"), "stopped"), epoch).alias("k"))
        rest = before.join(last.select(run), run, "left_anti")
        last.select(run, "k.*").unionByName(rest).write.mode("overwrite").parquet(f"{path}/known/batch={number}")

    return write


def epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """All log rows, with the number of their micro-batch."""
    return spark.read.option("basePath", f"{path}/log").parquet(*(f"{path}/log/batch={n}" for n in batches(spark, f"{path}/log")))


def may_stop(spark: SparkSession, path: str, run: str, run_type: str) -> bool:
    """Whether patience has run out for every run known so far, of which there is one at least."""
    return known(spark, path, run, run_type).agg(F.bool_and("stopped")).first()[0] is True
