"""Prefix trie of conversations by leaf-peeling message passing.

Conversations are rebuilt from shared first turns; every distinct sequence of first turns is a node. The trie is
never held anywhere: a node is a row, named by the sum of position-bound 64-bit hashes of its turns (two of them),
so the names along a conversation are running sums, its parent's name is a subtraction, and no text is shuffled.

Subtree totals travel by messages. A node keeps a counter of children that are not finished; a node whose counter
is zero sends its subtree's leaves and saved tokens to its parent, which adds them and counts down, until only
the root is left to finish. Deep conversations would take a round for each turn, so the nodes of one path are
peeled together: each node belongs to the member whose id has the smallest hash. The nodes of one such member
lie one below the other, so the units that hold counters and send messages are whole paths, and totals within a
path are a running sum from its end. As hashed ids are in random order, a path from the root meets new smallest
members about ln(members) times however deep it is, which bounds the rounds. Each round writes what is left to
the shared folder, so a lost executor repeats one round.

Hot keys: places and sums within a conversation or path are taken by ranges (`placed`), so one of any length is
spread; counters and messages are sums with partial aggregation; where many rows meet one row of a table, the
at most `HOT` keys with more than a `HOT`-th of the rows are broadcast and the rest shuffled. The ids of those that end at a
node are put together in chunks of at most 4,096 neighbouring ids, and the chunks go through SHA-256 one by one.

Defined results: turns are ordered by their number (null first), equal numbers by the MD5 of the MD5s of role and
text, written in hex; null roles and texts are empty; rows with a null conversation id take no part; repeated rows are turns of
their own; an empty table has no nodes, not even a root. Other columns are not read; ids are cast to long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.ordinals import placed
from frameloom.session import staged

#: Conversations of one run of this many ids share the first turns of the run's first.
RUN = 20
#: A conversation has fewer than this many shared turns.
SHARED = 4
#: The most keys that are broadcast; each of them has more than this share of the rows.
HOT = 1000
#: Neighbouring ids that may stand in one chunk, as a power of two.
CHUNK_BITS = 12
ROOT = "0,0,0,0"
PIECES = ("k0", "k1", "k2", "k3")
LOW = 0xFFFFFFFF


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, content, words): each turn's place in its conversation, from 1, its digest and its number of words."""
    said, who = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(F.md5(who), F.md5(said))).alias("content"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart, whose order changes nothing
    )
    return staged(placed(rows, ["conv"], [F.asc_nulls_first("turn"), F.col("content"), F.col("row")], "place").drop("turn", "row"), "turns")


def joined(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of keyed, which has one row per key and the number of rows that have it."""
    is_hot = F.col(size) > total // HOT
    hot = keyed.where(is_hot)  # at most HOT keys can have so many rows each
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def shared_turns(conv: Column, most: int = SHARED) -> Column:
    """How many first turns a conversation shares."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(most))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, steps): conv and length of each rebuilt conversation; conv, length, depth, content and words of each of its turns."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"base": F.col("conv") - F.col("conv") % RUN, "h": shared_turns(F.col("conv"))})
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").withColumn("lead", lead)
    convs = staged(convs.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    heads = turns.where(F.col("place") < SHARED).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "content", "words")
    first = convs.join(heads, "base").where(F.col("depth") <= F.col("h"))
    later = joined(turns, convs, "conv", "n", turns.count()).where(F.col("place") > F.col("h")).withColumn("depth", F.col("place") - F.col("h") + F.col("lead"))
    columns = ["conv", "length", "depth", "content", "words"]
    return convs, first.select(*columns).unionByName(later.select(*columns))


def named(steps: DataFrame) -> DataFrame:
    """(conv, length, depth, node, parent, words): the node that each turn of a rebuilt conversation leads to."""
    a, b = F.xxhash64("depth", "content"), F.xxhash64("content", "depth", F.lit("second"))
    parts = [a.bitwiseAND(LOW), F.shiftrightunsigned(a, 32), b.bitwiseAND(LOW), F.shiftrightunsigned(b, 32)]
    steps = steps.withColumns({f"own_{k}": p for k, p in zip(PIECES, parts)})
    summed = placed(steps, ["conv"], [F.col("depth")], "at", {k: F.col(f"own_{k}") for k in PIECES})
    node = F.concat_ws(",", *PIECES)
    parent = F.concat_ws(",", *(F.col(k) - F.col(f"own_{k}") for k in PIECES))
    return staged(summed.select("conv", "length", "depth", node.alias("node"), parent.alias("parent"), "words"), "steps")


def nodes_of(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, parent, depth, words, n_convs, conv_id, path) of every node; path is the member with the smallest hash."""
    members = [F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min(F.struct(F.xxhash64("conv"), "conv")).alias("least")]
    below = steps.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), *members)
    top = convs.groupBy().agg(*members).where("n_convs > 0")
    top = top.withColumns({"node": F.lit(ROOT), "parent": F.lit(None).cast("string"), "depth": F.lit(0).cast("long"), "words": F.lit(0).cast("long")})
    every = below.unionByName(top)
    return staged(every.withColumn("path", F.col("least.conv")).drop("least"), "nodes")


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, parent_conv_id and parent_path."""
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n"))
    parents = staged(children.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path")), "parent"), "parents")
    own = nodes.join(parents.select(F.col("parent").alias("node"), F.col("n").alias("n_children")), "node", "left").fillna(0, ["n_children"])
    below = joined(own.where("parent IS NOT NULL"), parents, "parent", "n", nodes.count()).drop("n")
    return staged(below.unionByName(own.where("parent IS NULL"), allowMissingColumns=True), "linked")


def peeled(paths: DataFrame) -> tuple[DataFrame, int]:
    """((path, leaves, saved) with all that hangs below each path, number of rounds).

    paths: (path, up, leaves, saved), up the path that it hangs from, null for the root's.
    """
    hanging = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("remaining"))
    live = staged(paths.join(hanging, "path", "left").fillna(0, ["remaining"]), "live")
    finished = []
    while not live.isEmpty():
        ready = live.where("remaining = 0")
        finished.append(ready.select("path", "leaves", "saved"))
        messages = ready.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        waiting = live.where("remaining > 0").join(messages, "path", "left").fillna(0, ["n", "more_leaves", "more_saved"])
        live = staged(waiting.select("path", "up", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("remaining") - F.col("n")).alias("remaining")), "live", small=True)
    return (reduce(DataFrame.unionByName, finished) if finished else live.select("path", "leaves", "saved")), len(finished)


def with_totals(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens of their subtrees."""
    each = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "top": F.col("parent").isNull() | (F.col("path") != F.col("parent_path"))})
    paths = each.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(F.col("top"), F.col("parent_path"))).alias("up"))
    totals, _ = peeled(paths)
    tops = each.where(F.col("top") & F.col("parent").isNotNull()).select("path", F.col("parent").alias("node"))
    arrived = tops.join(totals, "path").groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    each = each.join(arrived, "node", "left").fillna(0, ["more_leaves", "more_saved"])
    sums = {"n_leaves": F.col("leaves") + F.col("more_leaves"), "saved_tokens": F.col("saved") + F.col("more_saved")}
    return placed(each, ["path"], [F.desc("depth")], "at", sums)


def ended(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end."""
    last = steps.where(F.col("depth") == F.col("length")).select("node", "conv")
    last = last.unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv"))
    chunks = last.groupBy("node", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digest(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for pdf in pdfs:
            out = []
            for name, ids in zip(pdf["node"], pdf["ids"]):
                if name != node:
                    out += [(node, sha.hexdigest())] if sha else []
                    node, sha = name, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInPandas(digest, "node string, ends_sha256 string")


def trie_report(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, steps = rebuilt(turns_of(conversations, conv, turn, role, text))
    steps = named(steps)
    nodes = with_totals(linked(nodes_of(convs, steps)))
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    whole = nodes.join(ended(convs, steps), "node", "left")
    return whole.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))
