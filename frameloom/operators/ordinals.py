"""Places and running sums within few large groups, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import staged


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, running: dict[str, Column] | None = None) -> DataFrame:
    """df with each row's place in its group, from 1, and running sums up to it; rows without a group are left out.

    Rows are dealt by ranges of group and order, so neither a large group nor a value that most rows share
    stays in one task as long as the order tells rows apart. A range's rows are numbered by themselves,
    and the sizes and sums of the ranges before it are added. The ranges are written first, because both
    steps have to see the same ones.
    """
    running = running or {}
    known = df
    for c in by:
        known = known.where(F.col(c).isNotNull())
    parts = staged(known.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{k}") for k, c in running.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = {"_n": "_n_before"} | {f"_sum_{k}": f"_before_{k}" for k in running}
    offsets = sums.select(*by, "_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for c, n in before.items()))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.join(offsets, [*by, "_range"])
    rows = rows.withColumns({name: F.col("_n_before") + F.row_number().over(inside), **{k: F.col(f"_before_{k}") + F.sum(c).over(upto) for k, c in running.items()}})
    return rows.drop("_range", *before.values())
