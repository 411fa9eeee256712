"""Guards, collected assertions and gated outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIOLATIONS = "check_name string, measured double, expected double, diff double, severity string"


#: Partitions that nobody reads without saying so.
HELD_OUT = frozenset({"test"})


class HeldOut(PermissionError):
    """Held-out partitions were asked for without saying so."""


class Violations(ValueError):
    """An output was refused because checks failed."""


def split_rows(df: DataFrame, partitions: Sequence[str], allow_test: bool = False, column: str = "split", held_out: frozenset[str] = HELD_OUT) -> DataFrame:
    """Rows of the named partitions, whatever the case and blanks of names on either side.

    Those held out need allow_test, else nothing is read at all; a partition without rows is an error.
    """
    asked = frozenset(map(str.lower, map(str.strip, partitions)))
    if shut := asked & held_out - (held_out if allow_test else frozenset()):
        raise HeldOut(f"{', '.join(sorted(shut))}: held out, to be read only with allow_test")
    name = F.lower(F.trim(column))
    rows = df.where(name.isin(*asked))
    there = rows.agg(F.collect_set(name)).first()[0]  # as many names as were asked for, at most
    if lost := asked.difference(there):
        raise ValueError(f"no rows in {sorted(lost)}")
    return rows


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """df, or an error that names what is missing and what is there, before anything runs."""
    if lost := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing {lost}; there are {df.columns}")
    return df


def check(df: DataFrame, name: str, measured: Column, expected: Column | float, tolerance: float = 0.0, severity: str = "failure") -> DataFrame:
    """One row of measured against expected with a signed difference; severity "ok" within the tolerance."""
    want = expected if isinstance(expected, Column) else F.lit(float(expected))
    row = df.agg(measured.cast("double").alias("measured"), want.cast("double").alias("expected"))
    diff = F.coalesce(F.col("measured") - F.col("expected"), F.lit(float("nan")))
    return row.select(F.lit(name).alias("check_name"), "measured", "expected", diff.alias("diff"), F.when(F.abs(diff) <= tolerance, "ok").otherwise(severity).alias("severity"))


def all_checks(spark: SparkSession, checks: Sequence[DataFrame]) -> DataFrame:
    """All checks as one table, so that every failure is seen and not just the first."""
    out = spark.createDataFrame([], VIOLATIONS)
    for c in checks:
        out = out.unionByName(c)
    return out


def violations(spark: SparkSession, checks: Sequence[DataFrame]) -> DataFrame:
    return all_checks(spark, checks).where("severity <> 'ok'")


def write_if_clean(df: DataFrame, found: DataFrame, path: str) -> None:
    """Write df only if no check failed; notes do not stop it."""
    failed = found.where("severity = 'failure'").limit(50).collect()
    if failed:
        raise Violations("; ".join(f"{r['check_name']}: {r['measured']} against {r['expected']}" for r in failed))
    df.write.mode("overwrite").parquet(path)


def compared(got: DataFrame, recorded: DataFrame, on: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Recomputed values against recorded ones: difference and whether it is within the tolerance; lost keys fail."""
    a, b = got.select(*on, F.col(value).alias("got")), recorded.select(*on, F.col(value).alias("want"))
    return a.join(b, list(on), "full_outer").withColumns({"diff": F.col("got") - F.col("want"), "same": F.coalesce(F.abs(F.col("got") - F.col("want")) <= tolerance, F.lit(False))})


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two sets holds; empty if they are equal."""
    a, b = left.distinct(), right.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
