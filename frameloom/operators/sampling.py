"""Deterministic draws: rows are taken in the order of a hash of their keys, so any cluster draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.aggregates import percentiles
from frameloom.operators.ordinals import placed


def draw_key(seed: int | Column, *keys: Column) -> Column:
    """A hash of the seed and the row's keys; followed by the keys it is a total order."""
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *(k.cast("string") for k in keys)))


def deciles(df: DataFrame, value: str, parts: int = 10) -> Column:
    """The inner edges that cut a column into equal parts, as a literal array (a fixed number of values)."""
    found = percentiles(df, [], value, [i / parts for i in range(1, parts)]).first()
    return F.array(*(F.lit(float(e)) for e in found or [])).cast("array<double>")


def draw_rank(df: DataFrame, cell: Sequence[str], seed: int | Column, keys: Sequence[str], name: str = "_rank") -> DataFrame:
    """df with each row's place in its cell's draw order; rows without a cell are left out.

    Cells are few and may hold most rows, so a cell is ranked in 256 parts by the first byte of the hash,
    and the sizes of the parts before are added.
    """
    rows = df.withColumn("_key", draw_key(seed, *map(F.col, keys))).withColumn("_part", F.substring("_key", 1, 2))
    earlier = Window.partitionBy(*cell).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*cell, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*cell, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy(*cell, "_part").orderBy("_key", *keys)
    return rows.join(sizes, [*cell, "_part"]).withColumn(name, F.col("_before") + F.row_number().over(order)).drop("_key", "_part", "_before")


def stratified(pool: DataFrame, wanted: DataFrame, cell: Sequence[str], ratio: float, seeds: Sequence[int], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(draws, cells): per seed and cell, ratio times the wanted rows of the cell, without replacement.

    A cell that holds too little is drawn whole and its shortfall recorded, never filled from elsewhere;
    cells without wanted rows are skipped.
    """
    quota = wanted.groupBy(*cell).agg(F.count("*").alias("n_wanted")).withColumn("quota", F.floor(F.col("n_wanted") * ratio).cast("long"))
    have = pool.groupBy(*cell).agg(F.count("*").alias("available"))
    cells = quota.join(have, list(cell), "left").fillna(0, ["available"])
    cells = cells.withColumns({"drawn": F.least("quota", "available"), "shortfall": F.greatest(F.col("quota") - F.col("available"), F.lit(0))})
    rows = pool.join(quota.drop("n_wanted"), list(cell)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    draws = draw_rank(rows, [*cell, "seed"], F.col("seed"), keys)
    return draws.where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota"), cells


def share_of_each(df: DataFrame, group: Sequence[str], fraction: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """A fixed share of every group, at least one row."""
    n = F.col("_of")
    sizes = df.groupBy(*group).agg(F.count("*").alias("_of"))
    rows = draw_rank(df, group, seed, keys).join(sizes, list(group))
    return rows.where(F.col("_rank") <= F.greatest(F.lit(1), F.least(F.bround(n * fraction, 0), n))).drop("_rank", "_of")


def capped(df: DataFrame, group: Sequence[str], member: str, per_group: int, seed: int, keys: Sequence[str], per_member: int = 1) -> DataFrame:
    """At most per_group rows per group, one per member before any second one, at most per_member each."""
    inner = Window.partitionBy(*group, member).orderBy(draw_key(seed, *map(F.col, keys)), *keys)
    rows = df.withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= per_member)
    outer = Window.partitionBy(*group).orderBy("_turn", draw_key(seed + 1, *map(F.col, keys)), *keys)
    return rows.withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= per_group).drop("_turn", "_rank")


def uniform_between(low: Column, high: Column, seed: int, *keys: Column) -> Column:
    """An integer from low to high (both included), fixed by the seed and the keys."""
    return low + F.pmod(F.conv(F.substring(draw_key(seed, *keys), 1, 12), 16, 10).cast("long"), high - low + 1)


def borrowed(df: DataFrame, sizes: DataFrame, group: Sequence[str], seed: int, keys: Sequence[str], columns: Sequence[str], size_keys: Sequence[str]) -> DataFrame:
    """Every row with the columns of a size row drawn (with replacement) from its own group."""
    numbered = placed(sizes, group, [F.col(c) for c in size_keys], "_place").select(*group, *columns, (F.col("_place") - 1).alias("_at"))
    count = sizes.groupBy(*group).agg(F.count("*").alias("_n"))
    rows = df.join(count, list(group)).withColumn("_at", uniform_between(F.lit(0), F.col("_n") - 1, seed, *map(F.col, keys)))
    return rows.join(numbered, [*group, "_at"]).drop("_at", "_n")


def repeats(df: DataFrame, fraction: float, seed: int, keys: Sequence[str], name: str = "repeat_id", prefix: str = "R") -> DataFrame:
    """A tenth (or another share, at least one row) of all rows to be scored again, numbered in draw order."""
    n = max(1, round(df.count() * fraction))
    rows = draw_rank(df.withColumn("_cell", F.lit(1)), ["_cell"], seed, keys).where(F.col("_rank") <= n)
    return rows.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_rank").cast("string"), 3, "0"))).drop("_rank", "_cell")
