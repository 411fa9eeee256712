"""Observation tables derived from the driver's tables.

Each definition is SQL that Spark and DuckDB read alike, so that one text serves the query and its check.
Names in braces are other definitions or driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from frameloom.session import table

VIEWS = {
    # lines of an order, numbered by a total order of their columns
    "lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_returnflag, l_linestatus, l_shipdate,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS idx,
          CAST(floor(l_quantity) AS bigint) AS q
        FROM {lineitem}""",
    # boxes of a frame: annotated ones and detections
    "boxes": """
        SELECT l_orderkey AS frame, CAST(idx AS bigint) AS idx, CASE WHEN idx % 2 = 1 THEN 'gt' ELSE 'blob' END AS kind,
          concat('v', CAST(l_orderkey % 30 AS string)) AS video,
          CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
          concat('s', CAST(l_orderkey % 3 AS string)) AS scene,
          CASE WHEN l_orderkey % 2 = 0 THEN '160x120' ELSE '320x240' END AS resolution,
          (l_partkey * 37) % 160 AS x, (l_suppkey * 53 + idx * 11) % 120 AS y, 20 + q AS w, 20 + q % 17 AS h
        FROM {lines}""",
    "gts": "SELECT * FROM {boxes} WHERE kind = 'gt'",
    "blobs": "SELECT * FROM {boxes} WHERE kind = 'blob'",
    # positions of one subject over its own frames; picking one kind of event leaves gaps between frames
    "tracks": """
        SELECT user_id AS video, event_type AS track_id, event_id, ts, value AS cx, CAST((event_id * 31) % 50 AS double) AS cy,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS frame,
          CAST(40 + event_id % 60 AS double) AS w, CAST(30 + event_id % 25 AS double) AS h
        FROM {events}""",
    # one object in each frame of a video; frames count from 1, since frame 0 is empty
    "scenes": """
        SELECT event_id, concat('u', CAST(user_id AS string)) AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS frame,
          CAST(floor(value) AS bigint) % 40 AS x, (event_id * 7) % 24 AS y, 4 + event_id % 5 AS w, 3 + event_id % 4 AS h, event_id % 3 AS tint
        FROM {events}""",
    # ranked proposals: unlabelled ones are ignored
    "scored": """
        SELECT d.doc_id, d.lang AS grp, d.n_chars AS score, CASE WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'negative' ELSE 'ignored' END AS label
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # every annotated object, found or not
    "truth": "SELECT d.lang AS grp, d.doc_id, d.n_chars FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id WHERE l.quality = 1",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a driver table of that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in _needs(name)})


def duck(*names: str) -> str:
    """The head of a DuckDB query over derived tables: WITH RECURSIVE and all definitions they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**{m: m for m in _needs(n)})})" for n in order)
