"""N-gram Jaccard self-join of texts with several global token orders.

Two texts whose shingle sets have Jaccard similarity t or more must share a token among the first
n - ceil(t n) + 1 tokens of each set, under any one order of all tokens. The join uses three orders and
lets only pairs through that share such a prefix token under every one of them; these are verified.

The first order puts tokens that occur in few sets in front. For that, half of the token space (by hash) is
counted over all sets; these tokens come first, by their number of sets and then by hash, the others follow
by hash. Where a set's unique tokens alone fill its prefix it has no partner and is done - of ordinary
text, nearly all of it. Tokens travel as six-byte fingerprints in blocks of many documents; equal
fingerprints of different tokens only make more candidates.

Counting does not gather the holders of a token: within a block, a token that several of its sets hold
is sent as one row with a number, so a token of very many sets is one small entry per block.

What is left is split into classes that are connected by shared prefix tokens of the first order. Classes
that are too large for one task are split again by the prefix tokens of the second order, and these by the
third; linked texts share one under every order, so they are never split. What is still too large is cut
into blocks of bounded size, near copies together: by the smallest token of the second order, and a token of
too many sets into several blocks. A member goes to another block only if it shares a prefix token with some
member there under each of the three orders, so a class that common passages hold together sends its sets
to few blocks. Tokens that every block of a class holds are one mark per member instead of a row per block.
Each pair of blocks is one task-sized group, in which a pair of members has to
share a prefix token under all three orders before matrix products of set memberships verify it. A group
sends one row per member - the smallest member it reaches and how many documents it links to - so no pair is
ever a row. Equal sets are one member throughout, with the number of its copies.

Defined results: words are between ASCII white space, in ASCII lower case; null texts and texts without
words have the empty set and link with nothing; ids may be null or repeat, each row is a document; a
class is named by the smallest id in it (null if all its ids are null); ids are integers or cast to
long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.components import components
from frameloom.llm.frames import arrow_types, keyed_texts, named, numbered, over_batches, record
from frameloom.llm.text import mix, sorted_unique, word_sets
from frameloom.session import staged

U64 = np.uint64
#: One number per order, so that the orders are independent of each other.
ORDERS = (U64(0x8CB92BA72F3D8DD7), U64(0x3C79AC492BA7B653), U64(0x1C69B3F74AC4AE35))
SHINGLE = 5
#: The similarity as a fraction, so that comparisons are exact.
AT_LEAST = (3, 4)
#: Tokens of a block of documents, of a group of fingerprints, and of a block of a class.
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
CLASS_TOKENS = 200_000
#: Members of a block of a class, and of each side that is compared at once.
CLASS_MEMBERS = 256
TILE = 256
#: Members up to which their keys are sent to all tasks.
BROADCAST_ROWS = 500_000
CHUNK = 8192


#: Columns of a member that go to its groups.
SENT = ("tokens", "shown", "label", "node", "copies")
META = [("node", "S16"), ("n", "<u4"), ("counted", "<u4")]
HOLDERS = [("token", "<u8"), ("member", "<u4")]


def prefix_length(n, at_least: tuple[int, int] = AT_LEAST):
    return n - -(-n * at_least[0] // at_least[1]) + 1


def signature(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return np.array([mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64), mix(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64)], ">u8").tobytes()


def set_table(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, version, n_shingles, node) of each row; node is null for the empty set."""

    def run(batch: pa.RecordBatch) -> dict:
        n, nodes = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for i, s in word_sets(batch.column(1), k):
            n[i] = len(s)
            nodes[i] = signature(s) if len(s) else None
        return {"doc_id": batch.column(0), "version": batch.column(2), "n_shingles": n, "node": nodes}

    return over_batches(texts.select("doc_id", "text", "version"), run, "doc_id long, version long, n_shingles long, node binary")


def blocks_of_tokens(sets: DataFrame, k: int, at_least: tuple[int, int], n_buckets: int) -> DataFrame:
    """(bucket, block, members, tokens, common, times, meta, holders): the tokens of the first order that each set has to show.

    tokens: fingerprints of six bytes, members: the set's place in its block (two or four bytes), for tokens
    that one set of the block holds. common: fingerprints that several hold, times: by how many. With one
    row of each block go meta (node, size, and number of tokens of the counted half of each member) and
    holders (members of the common tokens of the whole block, with the tokens).
    """
    schema = "bucket int, block long, members binary, tokens binary, common binary, times binary, meta binary, holders binary"
    names, types = [x.split()[0] for x in schema.split(", ")], arrow_types(sets, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, size = 0, 0
        meta, shown = [], []

        def flush() -> pa.RecordBatch:
            six = np.concatenate(shown).astype("<u8").view(np.uint8).reshape(-1, 8)
            six[:, :2] = 0
            h = six.reshape(-1).view("<u8")
            member = np.repeat(np.arange(len(shown), dtype="<u4"), [len(x) for x in shown])
            turned = h << U64(1) | h >> U64(63)  # tokens of the counted half, nearly all, differ from the second bit on
            order = np.argsort(turned)
            h, member = h[order], member[order]
            bucket = (turned[order] >> U64(65 - n_buckets.bit_length())).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(first, len(h)))
            several = np.repeat(times > 1, times)
            one, many = np.flatnonzero(~several), first[times > 1]
            buckets = np.arange(n_buckets + 1)
            at, own = np.searchsorted(bucket[one], buckets), np.searchsorted(bucket[many], buckets)
            block = part << 24 | seq
            cut = lambda x, ends: [x[ends[b] : ends[b + 1]].tobytes() for b in used]
            bare = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:]
            small = member[one].astype("<u2") if len(shown) <= 65536 else member[one]
            used = sorted({*np.flatnonzero(np.diff(at) + np.diff(own)).tolist(), block % n_buckets})
            held = np.zeros(int(several.sum()), HOLDERS)
            held["token"], held["member"] = h[several], member[several]
            about = np.array(meta, dtype=META).tobytes()
            here = [b == block % n_buckets for b in used]
            return record({
                "bucket": used, "block": [block] * len(used),
                "members": cut(small, at), "tokens": cut(bare(h[one]), at), "common": cut(bare(h[many]), own), "times": cut(times[times > 1].astype("<u4"), own),
                "meta": [about if x else None for x in here], "holders": [held.tobytes() if x else None for x in here],
            }, names, types)

        last = None
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for i, s in word_sets(batch.column(1), k):
                if not len(s) or nodes[i] == last:
                    continue
                last = nodes[i]
                h = np.sort(mix(s ^ ORDERS[0]))
                counted = int(np.searchsorted(h, U64(1 << 63)))
                h = h[: max(counted, prefix_length(len(s), at_least))]
                meta.append((nodes[i], len(s), counted))
                shown.append(h)
                size += len(h)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    seq, size = seq + 1, 0
                    meta, shown = [], []
        if shown:
            yield flush()

    return sets.mapInArrow(run, schema)


def fingerprints(six: bytes) -> np.ndarray:
    raw = np.frombuffer(six, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view("<u8").reshape(-1)


def count_sets(table: pa.Table) -> pa.Table:
    """Per row of a bucket: the tokens that occur in two sets or more, with the number of sets and, of those of one set, the member."""
    one, common = ([fingerprints(x) for x in table.column(c).to_pylist()] for c in ("tokens", "common"))
    wide = [np.frombuffer(m, "<u2" if len(m) == 2 * len(t) else "<u4").astype("<u4") for m, t in zip(table.column("members").to_pylist(), one)]
    times = [np.frombuffer(x, "<u4") for x in table.column("times").to_pylist()]
    every = np.concatenate(one + common)
    weight = np.concatenate([np.ones(sum(map(len, one)), np.int64), *times]).astype(np.int64)
    _, group = np.unique(every, return_inverse=True)
    sets = np.bincount(group, weight).astype("<u4")[group]
    n_one = sum(map(len, one))
    row = np.repeat(np.arange(len(one)), [len(t) for t in one])
    keep = np.flatnonzero(sets[:n_one] > 1)
    bounds = np.searchsorted(row[keep], np.arange(len(one) + 1))
    ends = n_one + np.cumsum([0, *map(len, common)])
    member = np.concatenate(wide)
    cut = lambda x: pa.array([x[keep[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
    own = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
    return pa.table({"block": table.column("block"), "members": cut(member), "tokens": cut(every), "sets": cut(sets), "common": own(every), "common_sets": own(sets), "meta": table.column("meta"), "holders": table.column("holders")})


def prefixes(table: pa.Table, at_least: tuple[int, int]) -> pa.Table:
    """(node, n, tokens) of the members of a block that may have partners: prefix tokens shared with other sets."""
    the = lambda name, kind: np.frombuffer(next(m for m in table.column(name).to_pylist() if m is not None), kind)
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    meta, held = the("meta", META), the("holders", HOLDERS)
    raw = np.frombuffer(meta.tobytes(), np.uint8).reshape(-1, 24)[:, :16]
    common, common_sets = join("common", "<u8"), join("common_sets", "<u4")
    order = np.argsort(common, kind="stable")
    at = order[np.searchsorted(common[order], held["token"])] if len(held) else np.zeros(0, np.int64)
    member = np.concatenate([join("members", "<u4"), held["member"]])
    token = np.concatenate([join("tokens", "<u8"), held["token"]])
    sets = np.concatenate([join("sets", "<u4"), common_sets[at]])
    late = token >> U64(63)
    order = np.lexsort((token, np.where(late == 0, sets, 0), late, member))
    member, token, late = member[order], token[order], late[order]
    bounds = np.searchsorted(member, np.arange(len(meta) + 1))
    nodes, sizes, kept = [], [], []
    for i in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[i], bounds[i + 1]
        counted = int(b - a - late[a:b].sum())
        free = prefix_length(int(meta["n"][i]), at_least) - (int(meta["counted"][i]) - counted)
        if free <= 0:
            continue
        found = token[a:b] if free > counted else token[a : a + free]
        if len(found):
            nodes.append(raw[i].tobytes())
            sizes.append(int(meta["n"][i]))
            kept.append(found.astype("<i8"))
    n = np.array([0, *map(len, kept)])
    flat = np.concatenate(kept) if kept else np.zeros(0, "<i8")
    return pa.table({"node": pa.array(nodes, pa.binary()), "n": pa.array(sizes, pa.int64()), "tokens": pa.ListArray.from_arrays(np.cumsum(n).astype(np.int32), flat)})


def products(a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, shape: tuple[int, int], n_columns: int) -> np.ndarray:
    """Common columns of each pair of rows; (rows, columns) lists in ascending order of columns."""
    out = np.zeros(shape, np.float32)
    for low in range(0, n_columns, CHUNK):
        x, y = slice(*np.searchsorted(a, [low, low + CHUNK])), slice(*np.searchsorted(b, [low, low + CHUNK]))
        left, right = np.zeros((shape[0], CHUNK), np.float32), np.zeros((shape[1], CHUNK), np.float32)
        left[rows_a[x], a[x] - low] = 1
        right[rows_b[y], b[y] - low] = 1
        out += left @ right.T
    return out


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    row_l = np.repeat(np.arange(len(left)), [len(s) for s in left])
    row_r = np.repeat(np.arange(len(right)), [len(s) for s in right])
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(all_l, all_r)
    if not len(both):
        return np.zeros((len(left), len(right)), np.float32)

    def listed(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        hit = both[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    (cols_l, rows_l), (cols_r, rows_r) = listed(all_l, row_l), listed(all_r, row_r)
    return products(cols_l, cols_r, rows_l, rows_r, (len(left), len(right)), len(both))


def order_prefix(s: np.ndarray, order: np.uint64, p: int) -> np.ndarray:
    h = mix(s ^ order)
    return h if p >= len(h) else np.partition(h, p - 1)[:p]


Members = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def with_prefixes(tokens: bytes, first: list[int], at_least: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """A set, and its prefix tokens under each order; under the first one, those that other sets share."""
    s = np.frombuffer(tokens, "<u8")
    p = prefix_length(len(s), at_least)
    return (s, np.array(first, np.int64).view(U64), *(order_prefix(s, o, p) for o in ORDERS[1:]))


def linked(left: Members, right: Members, at_least: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets reach the similarity; the orders' filters are intersected before verification."""
    size_l, size_r = (np.array([len(x[0]) for x in side], np.int64) for side in (left, right))
    small, large = np.minimum(size_l[:, None], size_r), np.maximum(size_l[:, None], size_r)
    open_pairs = small * at_least[1] >= large * at_least[0]
    for order in range(1, 1 + len(ORDERS)):
        if not open_pairs.any():
            return open_pairs
        open_pairs &= common([x[order] for x in left], [x[order] for x in right]) > 0
    out = np.zeros(open_pairs.shape, bool)
    rows, cols = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
    if len(rows):
        both = common([left[i][0] for i in rows], [right[j][0] for j in cols]).astype(np.int64)
        union = size_l[rows][:, None] + size_r[cols] - both
        out[np.ix_(rows, cols)] = (both * at_least[1] >= union * at_least[0]) & open_pairs[np.ix_(rows, cols)]
    return out


def linked_in_tiles(left: Members, right: Members, same: bool, at_least: tuple[int, int]) -> np.ndarray:
    """As `linked`, some members of each side at once; with same, left and right are one list."""
    out = np.zeros((len(left), len(right)), bool)
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), TILE):
            hit = linked(left[a : a + TILE], right[b : b + TILE], at_least)
            out[a : a + TILE, b : b + TILE] = hit
            if same:
                out[b : b + TILE, a : a + TILE] = hit.T
    return out


def group_links(table: pa.Table, at_least: tuple[int, int]) -> pa.Table:
    """(node, root, n_linked) of the linked members of one pair of blocks of a class."""
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    nodes, blocks = table.column("node").to_pylist(), np.array(table.column("own").to_pylist())
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    copies = np.array(table.column("copies").to_pylist(), np.int64)
    sets, shown = table.column("tokens").to_pylist(), table.column("shown").to_pylist()
    part = [[i for i in order if blocks[i] == b] for b in (first, second)]
    values = [[with_prefixes(sets[i], shown[i], at_least) for i in p] for p in part]
    out_node, out_root, out_links = [], [], []
    if all(part):
        same = first == second
        hit = linked_in_tiles(values[0], values[1], same, at_least)
        if same:
            np.fill_diagonal(hit, False)
        members = part[0] if same else part[0] + part[1]
        shift = 0 if same else len(part[0])
        root = np.arange(len(members))
        links = np.zeros(len(members), np.int64)
        links[: len(part[0])] += hit @ copies[part[1]]
        if not same:
            links[shift:] += hit.T @ copies[part[0]]
        for _ in range(len(members)):  # every step carries the smallest place one link further
            low = np.where(hit, root[shift : shift + len(part[1])], len(members)).min(axis=1, initial=len(members))
            new = root.copy()
            new[: len(part[0])] = np.minimum(new[: len(part[0])], low)
            low = np.where(hit, new[: len(part[0])][:, None], len(members)).min(axis=0, initial=len(members))
            new[shift : shift + len(part[1])] = np.minimum(new[shift : shift + len(part[1])], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        for i in np.flatnonzero(links):
            out_node.append(nodes[members[i]])
            out_root.append(nodes[members[root[i]]])
            out_links.append(int(links[i]))
    return pa.table({"a": pa.array(out_node, pa.binary()), "b": pa.array(out_root, pa.binary()), "n_linked": pa.array(out_links, pa.int64())})


def connected(shared: DataFrame) -> DataFrame:
    """(node, label): the nodes of each label's rows (label, node, token) that tokens connect, under new labels."""
    least = shared.groupBy("label", "token").agg(F.min("node").alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    least = staged(least, "least", small=True)  # so that Spark can split the rows of a very frequent token in the join
    edges = shared.join(least, ["label", "token"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    return components(edges)


def prefix_rows(sets: DataFrame, order: int, at_least: tuple[int, int]) -> DataFrame:
    """(label, node, token): the prefix tokens of every member under one of the later orders."""

    def run(batch: pa.RecordBatch) -> dict:
        every = [np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()]
        return {"label": batch.column(1), "node": batch.column(2), "tokens": [order_prefix(s, ORDERS[order], prefix_length(len(s), at_least)).view(np.int64) for s in every]}

    rows = over_batches(sets.select("tokens", "label", "node"), run, "label binary, node binary, tokens array<long>")
    return rows.select("label", "node", F.explode("tokens").alias("token"))


def member_prefixes(large: DataFrame, at_least: tuple[int, int], class_tokens: int) -> DataFrame:
    """(label, node, own, by_order): the block and the prefix tokens under each order of the members of large classes.

    Members meet in a block by the smallest token of the second order, which texts of a similarity s share
    with probability s. Keys over half of a block's tokens have blocks of their own, as many as they need;
    these keys are no more than twice the blocks, and the others are light enough to be dealt by hash.
    """

    def run(batch: pa.RecordBatch) -> dict:
        every = [np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()]
        later = [[order_prefix(s, o, prefix_length(len(s), at_least)) for o in ORDERS[1:]] for s in every]
        return {
            "label": batch.column(1), "node": batch.column(2), "n": batch.column(3), "n_blocks": batch.column(4),
            "key": np.array([two.min() for two, _ in later], np.uint64).view(np.int64),
            "by_order": [[one, *(x.view(np.int64) for x in more)] for one, more in zip(batch.column(5).to_pylist(), later)],
        }

    schema = "label binary, node binary, n long, n_blocks int, key long, by_order array<array<long>>"
    members = staged(over_batches(large.select("tokens", "label", "node", "n", "n_blocks", "shown"), run, schema), "member-prefixes")
    weight = F.sum(F.greatest("n", F.lit(-(-class_tokens // CLASS_MEMBERS))))
    heavy = members.groupBy("label", "key").agg(weight.alias("weight")).where(F.col("weight") * 2 > class_tokens)
    heavy = staged(heavy.select("label", "key", F.ceil(F.col("weight") / class_tokens).alias("parts")), "heavy-keys", small=True)
    light = F.pmod(F.xxhash64("key"), F.col("n_blocks"))
    own = F.when(F.col("parts").isNull(), light).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts"))))
    return staged(members.join(heavy, ["label", "key"], "left").select("label", "node", own.alias("own"), "by_order"), "placed-members")


def visits(members: DataFrame) -> DataFrame:
    """(node, own, other): the blocks each member of `member_prefixes` has to be compared with, its own included.

    A member goes to a block if under every order it has a prefix token that the block has.
    """
    orders = lambda rows, *more: rows.select("label", "node", "own", *more, F.posexplode("by_order").alias("order", "of_order"))
    tokens = orders(members).select("label", "node", "own", "order", F.explode("of_order").alias("token"))
    blocks = staged(members.select("label", "own").distinct(), "blocks", small=True)
    n_own = blocks.groupBy("label").agg(F.count("*").alias("n_own"))
    by_token = ["label", "order", "token"]
    held = staged(tokens.select(*by_token, F.col("own").alias("other")).distinct(), "block-tokens")
    spread = held.groupBy(by_token).agg(F.count("*").alias("n_held")).where("n_held > 1").join(n_own, "label")
    spread = staged(spread.select(*by_token, (F.col("n_held") == F.col("n_own")).alias("everywhere")), "spread-tokens")

    bit = F.expr("shiftleft(1, order)")
    every = (1 << len(ORDERS)) - 1
    marks = tokens.join(spread.where("everywhere"), by_token).groupBy("node").agg(F.bit_or(bit).alias("marks"))
    marks = staged(marks, "marks", small=True)
    all_blocks = members.select("label", "node", "own").join(marks.where(F.col("marks") == every), "node").join(blocks.withColumnRenamed("own", "other"), "label")
    # marks meet members, not their tokens; the tokens of a marked order are not looked up
    rest = orders(members.join(marks, "node", "left"), F.coalesce("marks", F.lit(0)).alias("marks")).where(F.col("marks").bitwiseAND(bit) == 0)
    rest = rest.select("label", "node", "own", "marks", "order", F.explode("of_order").alias("token"))
    some = held.join(spread.where("NOT everywhere"), by_token).drop("everywhere")
    found = rest.join(some, by_token).groupBy("node", "own", "other").agg(F.bit_or(bit.bitwiseOR(F.col("marks"))).alias("orders"))
    found = found.where((F.col("orders") == every) & (F.col("own") != F.col("other"))).select("node", "own", "other")
    own = members.select("node", "own", F.col("own").alias("other"))
    return own.unionByName(all_blocks.where("own <> other").select("node", "own", "other")).unionByName(found)


def class_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, at_least: tuple[int, int] = AT_LEAST, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """Per row of docs: doc_id, version, n_shingles, component_id, n_links (documents it links to), class.

    class is one value for all rows of a class, whatever their ids; null for the empty set, of which each
    row is a class of its own.
    """
    texts = keyed_texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    base = staged(set_table(texts, k), "sets", small=True)
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "version"))
    each = base.where("node IS NOT NULL").groupBy("node", "doc_id", "version").agg(F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"))
    reps = each.groupBy("node").agg(chosen.alias("rep"), F.sum("rows").alias("copies"), F.max("rows").alias("rows"), F.first("n_shingles").alias("n"))
    reps = staged(reps.select("node", "copies", "rows", "n", F.col("rep.doc_id").alias("rep_id"), F.col("rep.version").alias("rep_version")), "reps", small=True)
    about = reps.agg(F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
    reps = reps.drop("rows")
    if (about["rows"] or 0) > 1:  # rows that share id and text
        texts = texts.dropDuplicates(["doc_id", "version"])
    keyed = lambda part: (F.col("doc_id").eqNullSafe(part["rep_id"])) & (F.col("version") == part["rep_version"])

    n_buckets = 1 << max(6, ((about["n"] or 0) // BUCKET_TOKENS).bit_length())
    counts = "block long, members binary, tokens binary, sets binary, common binary, common_sets binary, meta binary, holders binary"
    one_each = texts.join(reps.hint("shuffle_hash"), keyed(reps)).select("node", "text").sortWithinPartitions("node")
    shown = blocks_of_tokens(one_each, k, at_least, n_buckets)
    counted = shown.groupBy("bucket").applyInArrow(count_sets, counts)
    kept = counted.groupBy("block").applyInArrow(lambda t: prefixes(t, at_least), "node binary, n long, tokens array<long>")
    may = staged(kept, "prefixes", small=True)

    classes = connected(may.select(F.lit(bytearray()).alias("label"), "node", F.explode("tokens").alias("token")))
    members = classes.select("node").join(reps.select("node", "rep_id", "rep_version"), "node")
    if classes.count() <= BROADCAST_ROWS:  # of a fixed width
        members = F.broadcast(members)
    found = texts.join(members, keyed(members)).select("text", "node")

    def with_sets(batch: pa.RecordBatch) -> dict:
        return {"tokens": [s.astype("<u8").tobytes() for _, s in word_sets(batch.column(0), k)], "node": batch.column(1)}

    about_members = classes.join(may.withColumnRenamed("tokens", "shown"), "node").join(reps.select("node", "copies"), "node")
    sets = staged(over_batches(found, with_sets, "tokens binary, node binary").join(about_members, "node"), "member-sets")
    done = None
    for order in (1, 2, None):
        of_class = sets.groupBy("label").agg(F.sum(F.greatest("n", F.lit(-(-class_tokens // CLASS_MEMBERS)))).alias("weight"), F.count("*").alias("members")).where("members > 1")
        n_blocks = staged(of_class.select("label", F.ceil(F.col("weight") / class_tokens).cast("int").alias("n_blocks")), "class-blocks", small=True)
        placed = sets.join(n_blocks, "label")
        if order is None or not n_blocks.where("n_blocks > 1").limit(1).count():
            break
        fits = placed.where("n_blocks = 1").drop("n_blocks")
        done = fits if done is None else done.unionByName(fits)
        large = staged(placed.where("n_blocks > 1").drop("n_blocks"), "large-classes")
        split = connected(prefix_rows(large, order, at_least))
        sets = staged(large.drop("label").join(split, "node"), "split-classes")
    large = placed.where("n_blocks > 1")
    placed = placed.where("n_blocks = 1") if done is None else placed.where("n_blocks = 1").unionByName(done.withColumn("n_blocks", F.lit(1)))
    one_block = F.lit(0).cast("long")
    paired = placed.select(*SENT, one_block.alias("own"), one_block.alias("first"), one_block.alias("second"))
    if large.limit(1).count():
        met = staged(visits(member_prefixes(large, at_least, class_tokens)), "visits")
        met = large.select(*SENT).join(met, "node").select(*SENT, "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
        paired = paired.unionByName(met)
    # by all three, or Spark would keep a class that is together by its label in one task
    paired = paired.repartition("label", "first", "second")
    links = staged(paired.groupBy("label", "first", "second").applyInArrow(lambda t: group_links(t, at_least), "a binary, b binary, n_linked long"), "links", small=True)

    labels = components(links.where("a <> b").select("a", "b"))
    named = labels.join(reps.select("node", "rep_id"), "node").groupBy("label").agg(F.min("rep_id").alias("component"))
    component = labels.join(named, "label").select("node", "label", "component")
    n_linked = links.groupBy(F.col("a").alias("node")).agg(F.sum("n_linked").alias("n_linked"))
    # written first, so that rows of one text meet it in a plain join, which Spark can split
    info = staged(reps.join(component, "node", "left").join(n_linked, "node", "left").select(
        F.col("node").alias("of_node"), F.coalesce("label", "node").alias("class"), F.coalesce("component", "rep_id").alias("component"), (F.col("copies") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links")
    ), "classes-of-sets", small=True)
    joined = base.join(info, F.col("node") == F.col("of_node"), "left")
    alone = F.col("node").isNull()
    return joined.select("doc_id", "version", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class")


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, n_links."""
    return class_table(docs, id_col, text_col, **how).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each class one row of docs, with the smallest id (null only where no row of the class has one), then of the smallest text hash.

    Rows without words are classes of their own and all stay.
    """
    classes = staged(class_table(docs, id_col, text_col, **how), "classes", small=True)
    alone = F.col("class").isNull()
    each = classes.groupBy("class", "doc_id", "version").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "version", "n")).alias("first")
    keep = each.groupBy("class", F.when(alone, F.col("doc_id")).alias("own_id"), F.when(alone, F.col("version")).alias("own_version")).agg(first)
    again = ~alone & (F.col("first.n") > 1)
    keep = staged(keep.select(F.col("first.doc_id").alias("_doc"), F.col("first.version").alias("_version"), again.alias("_again")), "keep", small=True)
    rows, at = numbered(docs)
    keyed = rows.withColumn("_hash", F.xxhash64(F.coalesce(F.col(at[text_col]), F.lit(""))))
    same = F.col(at[id_col]).cast("long").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_version"))
    kept = keyed.join(keep.hint("shuffle_hash"), same)
    if keep.where("_again").limit(1).count():  # rows with words that share both id and text
        kept = kept.where("NOT _again").unionByName(kept.where("_again").dropDuplicates(["_doc", "_version"]))
    return named(kept, at)
