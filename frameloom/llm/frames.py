"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that an operator's function sees at once; what it makes of them is all that is held.
ROWS_AT_ONCE = 1024


def over_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply rows to slices of the Arrow batches; it gives the columns of schema (a dict of lists or arrays)."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield record(rows(batch.slice(at, ROWS_AT_ONCE)), names, types)

    types = arrow_types(df, schema)
    return df.mapInArrow(run, schema)


def arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]


def record(columns: dict, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    made = [pa.array(columns[n], t) if not isinstance(columns[n], pa.Array) else columns[n].cast(t) for n, t in zip(names, types)]
    return pa.RecordBatch.from_arrays(made, names)


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns as in_0, in_1, ..., so that no operator's column can clash, and these by old name."""
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in at.items())), at


def named(df: DataFrame, at: dict[str, str]) -> DataFrame:
    """The numbered columns under their old names."""
    return df.select(*(F.col(n).alias(c) for c, n in at.items()))
