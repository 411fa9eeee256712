"""Outputs: tables per seed, single sorted exports, run records and the access log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def per_value(df: DataFrame, column: str, path: str) -> None:
    """One table in folders by a column's values, so that readers of one value read nothing else."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def export_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """A sorted, headered CSV of the named columns; others are ignored. Large results become several ordered files."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def written_columns(df: DataFrame, policy: str, listed: Sequence[str] = ()) -> DataFrame:
    """df with the columns that a writer's policy keeps.

    "first": the listed columns, and a further one is an error; "appended": the listed columns, then further
    ones in their own order; "sorted": all columns of either side by name. Listed columns that df lacks are
    null strings.
    """
    more = [c for c in df.columns if c not in listed]
    if policy == "first" and more:
        raise ValueError(f"columns {more} are not among {list(listed)}")
    if policy not in ("first", "appended", "sorted"):
        raise ValueError(f"unknown policy {policy}")
    names = sorted({*listed, *more}) if policy == "sorted" else [*listed, *more]
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in names))


def log_epoch(spark: SparkSession, path: str, run: str, epoch: int, values: dict[str, float]) -> None:
    """Append one epoch's values to a run's log; what was written before stays whatever happens to the run."""
    row = spark.createDataFrame([(run, epoch, values)], "run string, epoch int, values map<string, double>")
    row.write.mode("append").parquet(path)


def run_record(df: DataFrame, parameters: dict[str, str], counts: dict) -> DataFrame:
    """One row of JSON: the parameters of a run and counts over its result."""
    row = df.agg(*(c.alias(n) for n, c in counts.items()))
    named = F.create_map(*(F.lit(x) for pair in sorted(parameters.items()) for x in pair)) if parameters else F.create_map()
    return row.select(F.to_json(F.struct(named.alias("parameters"), F.struct(*counts).alias("counts"))).alias("record"))


def log_access(spark: SparkSession, path: str, who: str, what: str, partitions: Sequence[str]) -> None:
    """Append a row to the access log."""
    row = spark.createDataFrame([(who, what, list(partitions))], "who string, what string, partitions array<string>")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def text_report(df: DataFrame, title: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(place, line): a title, the columns' names, and a line for each row in order, cells padded to 16 characters.

    For result tables, which are small; places are given by one sorted window.
    """
    cells = F.concat_ws("  ", *(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), 16, " ") for c in columns))
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("place"), cells.alias("line"))
    names = "  ".join(c[:16].rjust(16) for c in columns)
    return df.sparkSession.createDataFrame([(0, title), (1, names)], "place int, line string").unionByName(rows)
