"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.frames import record
from frameloom.session import staged

#: Edges that one task may take at once; larger graphs are contracted in rounds first.
LIMIT = 500_000
EDGES, LABELS = "a binary, b binary", "node binary, label binary"


def forest(pairs: Iterable[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """Every node of pairs with the smallest node of its component."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in parent}


def local_forests(edges: DataFrame, names: tuple[str, str] = ("a", "b"), batch_edges: int = LIMIT) -> DataFrame:
    """A table with the same components: per partition, each node with the smallest node it reaches there.

    With names a and b, a partition is taken in pieces of about batch_edges edges, so memory is bounded; the
    stars of the pieces together connect what the edges did. Labels need the whole partition, which the
    caller bounds.
    """
    schema = EDGES if names == ("a", "b") else LABELS
    loops = schema == LABELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[bytes, bytes]] = []
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(pairs) > batch_edges and not loops:
                yield from out(pairs)
                pairs = []
        if pairs:
            yield from out(pairs)

    def out(pairs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        stars = [(x, r) for x, r in forest(pairs).items() if loops or x != r]
        if stars:
            yield record(dict(zip(names, zip(*stars))), list(names), [pa.binary(), pa.binary()])

    return edges.mapInArrow(run, schema)


def components(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, label) of every node of edges (a, b): one label for each component.

    While the graph is larger than limit, each node moves to the smallest of itself and its neighbours
    and the edges follow; this at least halves the nodes that still have edges. What fits goes to one
    task of bounded size. Self-loops and repeated edges are allowed; an empty table gives no rows.
    """
    graph = staged(local_forests(edges), "graph", small=True)
    moves: list[DataFrame] = []
    while graph.count() > limit:
        ways = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = staged(ways.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "moves", small=True)
        moves.append(moved)
        to = lambda end: moved.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))  # noqa: E731, B023
        followed = graph.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        graph = staged(local_forests(followed), "graph", small=True)
    labels = local_forests(graph.coalesce(1), ("node", "label"))
    for moved in reversed(moves):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = moved.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return labels
