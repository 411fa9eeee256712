"""Classes of op5 that do not fit one block: which blocks a member goes to, and links that cross blocks."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from frameloom.llm import jaccard_join as jj
from tests.llm.data import docs_frame
from tests.llm.test_exact import joined_by_hand

SCHEMA = "tokens binary, shown array<long>, label binary, node binary, copies long, n long, n_blocks int"
AT_LEAST = (3, 4)


def prefixes_of(s: np.ndarray) -> list[set[int]]:
    return [set(jj.order_prefix(s, o, jj.prefix_length(len(s), AT_LEAST)).view(np.int64).tolist()) for o in jj.ORDERS]


def class_rows(sets: list[np.ndarray], label: bytes, n_blocks: int) -> list[tuple]:
    return [(s.astype("<u8").tobytes(), sorted(prefixes_of(s)[0]), label, b"%s%04d" % (label, i), 1, len(s), n_blocks) for i, s in enumerate(sets)]


def visits_by_hand(rows: list[tuple], block: dict[bytes, int]) -> set[tuple]:
    of = {r[3]: prefixes_of(np.frombuffer(r[0], "<u8")) for r in rows}
    held: dict[tuple, list[set[int]]] = {}
    for r in rows:
        mine = held.setdefault((r[2], block[r[3]]), [set(), set(), set()])
        for tokens, new in zip(mine, of[r[3]]):
            tokens |= new
    met = {(r[3], b) for r in rows for (label, b), tokens in held.items() if label == r[2] and all(x & y for x, y in zip(of[r[3]], tokens))}
    return met | {(r[3], block[r[3]]) for r in rows}


def test_members_go_to_the_blocks_that_share_tokens_under_every_order(spark):
    rng = np.random.default_rng(7)
    line = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    rng.shuffle(line)
    chain = [np.sort(line[i * 10 : i * 10 + 40]) for i in range(300)]
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    copies = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(90)]
    rows = class_rows(chain, b"c", 12) + class_rows(copies, b"k", 8)
    members = jj.member_prefixes(spark.createDataFrame(rows, SCHEMA).repartition(5), AT_LEAST, 1000)
    block = {bytes(r.node): r.own for r in members.collect()}
    assert set(block) == {r[3] for r in rows}
    got = [(bytes(r.node), r.own, r.other) for r in jj.visits(members).collect()]
    assert all(block[node] == own for node, own, _ in got)
    met = {(node, other) for node, _, other in got}
    assert len(met) == len(got) and met == visits_by_hand(rows, block)
    per_label = {x: len({b for n, b in block.items() if n.startswith(x)}) for x in (b"c", b"k")}
    assert per_label[b"c"] > 8 and per_label[b"k"] > 2
    chained = [x for x in met if x[0].startswith(b"c")]
    assert len(chained) < 0.6 * len(chain) * per_label[b"c"]  # not every member to every block
    assert len(met) - len(chained) > 0.9 * len(copies) * per_label[b"k"]  # near copies meet everywhere


def test_blocks_of_one_smallest_token_stay_bounded(spark):
    """All members have one smallest token of the second order."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 40000).astype(np.uint64)
    hot = pool[np.argmin(jj.mix(pool ^ jj.ORDERS[1]))]
    sets = [np.unique(np.append(rng.choice(pool, 30), hot)) for _ in range(400)]
    members = jj.member_prefixes(spark.createDataFrame(class_rows(sets, b"h", 13), SCHEMA), AT_LEAST, 1000)
    sizes = [r["count"] for r in members.groupBy("own").count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 10 and max(sizes) < 90


def test_a_chain_of_links_over_many_blocks(spark):
    """Each text links to its neighbours only; with copies of some, a hot text and unlinked chained ones."""
    rng = random.Random(21)
    words = ["q%d" % rng.randrange(10**6) for _ in range(900)]
    texts = [" ".join(words[i * 4 : i * 4 + 60]) for i in range(150)]
    texts += [" ".join(words[i * 25 : i * 25 + 60]) for i in range(30)] + texts[3:9] + [texts[40]] * 20
    rng.shuffle(texts)
    frame = docs_frame(spark, texts).repartition(6).withColumn("class", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jj.class_table(frame, class_tokens=400).collect()}
    assert got == joined_by_hand(texts)
