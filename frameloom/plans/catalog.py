"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.plans import boxes, containers, files, frames, ranking, relational, tracks

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (ranking.QUERIES, boxes.QUERIES, tracks.QUERIES, relational.QUERIES, files.QUERIES, frames.QUERIES, containers.QUERIES)


def queries() -> dict[str, Query]:
    return {name: run for family in FAMILIES for name, (run, _) in family.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.items() if sql}
