"""Lookups, reconciliation and window joins. Sides are broadcast by Spark's own size checks, not by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingKeys(ValueError):
    """Rows of a lookup have no partner."""


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], missing: str = "skip") -> DataFrame:
    """N:1 join. missing: "skip" drops rows without a partner, "null" keeps them, "raise" checks first."""
    if missing == "raise":
        lost = df.select(*on).distinct().join(dim.select(*on), list(on), "left_anti")
        if found := lost.limit(20).collect():
            raise MissingKeys(f"no partner for {[tuple(r) for r in found]}")
    return df.join(dim, list(on), "left" if missing == "null" else "inner")


def lookup_or(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left lookup; absent values become the defaults."""
    return df.join(dim, list(on), "left").fillna(defaults)


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Keys of either side with left_value, right_value, diff (left minus right, absent as 0) and side."""
    a, b = left.select(*on, F.col(value).alias("left_value")), right.select(*on, F.col(value).alias("right_value"))
    side = F.when(F.col("right_value").isNull(), "left only").when(F.col("left_value").isNull(), "right only").otherwise("both")
    zero = F.lit(0)
    return a.join(b, list(on), "full_outer").withColumns({"diff": F.coalesce("left_value", zero) - F.coalesce("right_value", zero), "side": side})


def only_in_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit("left only")).unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right only")))


def last_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the given order, as when later rows overwrite earlier ones."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*(c if c in key else F.col(f"_last.{c}").alias(c) for c in df.columns))


def aligned(tables: dict[str, DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """Inner join of several tables on one key; each table's value under the table's name."""
    out = None
    for name, df in tables.items():
        part = df.select(*key, F.col(value).alias(name))
        out = part if out is None else out.join(part, list(key))
    return out


def in_windows(centres: DataFrame, frames: DataFrame, by: Sequence[str], lead: int, trail: int, centre: str = "centre", frame: str = "frame") -> DataFrame:
    """Every centre with the frames from lead before to trail after it.

    Frames are bucketed by the window's length, so the join is an equi-join on (by, bucket) with a
    residual range test rather than a scan of a whole subject per centre.
    """
    span = lead + trail + 1
    a = centres.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(centre) - lead) / span), F.floor((F.col(centre) + trail) / span))))
    b = frames.withColumn("_bucket", F.floor(F.col(frame) / span))
    near = (F.col(frame) >= F.col(centre) - lead) & (F.col(frame) <= F.col(centre) + trail)
    return a.join(b, [*by, "_bucket"]).where(near).drop("_bucket")


def with_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Every row with every combination of the given literal values; no join takes place."""
    for name, each in values.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in each))))
    return df


def conditions(df: DataFrame, same: Column, first: str = "A", second: str = "B", name: str = "condition") -> DataFrame:
    """Each row under both conditions, or once under their joint name where the two coincide."""
    return df.withColumn(name, F.explode(F.when(same, F.array(F.lit(first + second))).otherwise(F.array(F.lit(first), F.lit(second)))))


def twins(df: DataFrame, on: Sequence[str], left: Column, right: Column, key: str) -> DataFrame:
    """(key, twin): each row for which left holds with the first row (by key) for which right holds on equal columns."""
    a = df.where(left).select(F.col(key), *on)
    b = df.where(right).groupBy(*on).agg(F.min(key).alias("twin"))
    return a.join(b, list(on)).select(key, "twin")


def paired(mapping: DataFrame, facts: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """A mapping table with the facts of both its ends: first_value and second_value."""
    a = facts.select(F.col(key).alias(first), F.col(value).alias("first_value"))
    b = facts.select(F.col(key).alias(second), F.col(value).alias("second_value"))
    return mapping.join(a, first, "left").join(b, second, "left")


def merged_keys(first: DataFrame, then: DataFrame, key: Sequence[str], tag: str, label: str) -> DataFrame:
    """Keyed union: all tags of a key as a sorted set; the label of the first table wins."""
    both = first.withColumn("_order", F.lit(0)).unionByName(then.withColumn("_order", F.lit(1)))
    return both.groupBy(*key).agg(F.sort_array(F.collect_set(tag)).alias("tags"), F.min(F.struct("_order", label))[label].alias(label))


def in_several(df: DataFrame, group: str, member: str) -> DataFrame:
    """Groups that lie in more than one member, with the sorted members."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(member)).alias("members")).where(F.size("members") > 1)
