"""Shards of packed ids as files: ranges by block offsets, bytes touched, memory maps, and what repeated tasks leave."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from frameloom.llm import packed_ids, queries
from tests.llm.data import AWKWARD, docs_frame


@pytest.fixture(scope="module")
def corpus(spark):
    texts = AWKWARD * 3 + [f"document {i} says {i * i} things" for i in range(2500)]
    shards = packed_ids.write_corpus(docs_frame(spark, texts).repartition(5), queries.tokenizer_file("byte_bpe_50k.json"), shard_ids=9000)
    index = packed_ids.with_base(shards).orderBy("start").collect()
    every = np.concatenate([packed_ids.Shard(np.memmap(r.path, np.uint8, "r")).ids(0, r.n_ids) for r in index])  # files that numpy can map
    return shards, index, every


def test_ranges_come_from_the_files(spark, corpus):
    shards, index, every = corpus
    assert len(index) > 2 and [r.start for r in index] == np.concatenate([[0], np.cumsum([r.n_ids for r in index])])[:-1].tolist()
    n = len(every)
    for first, last in ((0, n), (5, 6), (8990, 9010), (n - 3, n + 50), (100, 100), (n, n + 5), (17, 30_000)):
        got = sorted((r.start, r.ids) for r in packed_ids.id_range(shards, first, last).collect())
        assert [i for _, ids in got for i in ids] == every[first:last].tolist()
        assert not got or got[0][0] == first
    docs = packed_ids.corpus_report(shards).orderBy("start").collect()
    assert sum(r.n_tokens for r in docs) == n
    assert all(r.ids_crc32 == zlib.crc32(every[r.start : r.start + r.n_tokens].astype("<u4")) for r in docs)


def test_a_range_touches_only_its_blocks(corpus, monkeypatch):
    _, index, _ = corpus
    row = max(index, key=lambda r: r.n_ids)
    monkeypatch.setattr(packed_ids, "RUN_BLOCKS", 1)
    with packed_ids.StoredShard(row.path) as shard:
        head = shard.read_bytes
        assert head == 40 + 8 * (shard.n_blocks + 1) and shard.n_blocks > 2
        got = shard.ids(packed_ids.BLOCK + 7, packed_ids.BLOCK + 9)
        assert len(got) == 2 and shard.read_bytes - head == packed_ids.BLOCK * shard.bits // 8
        shard.ids(packed_ids.BLOCK - 1, packed_ids.BLOCK + 1)
        assert shard.read_bytes - head == 3 * packed_ids.BLOCK * shard.bits // 8
        assert packed_ids.doc_crcs(shard) == [zlib.crc32(shard.doc(i).astype("<u4")) for i in range(shard.n_docs)]


def test_files_are_whole_or_absent(corpus, tmp_path):
    shards, index, _ = corpus
    folder = os.path.dirname(index[0].path)
    assert sorted(os.path.join(folder, f) for f in os.listdir(folder)) == sorted(r.path for r in index)
    with pytest.raises(TypeError):
        packed_ids.put(f"{tmp_path}/a/x.ids", [1])
    assert not os.path.exists(f"{tmp_path}/a/x.ids")
    packed_ids.put(f"{tmp_path}/a/y.ids", b"abc")
    packed_ids.put(f"{tmp_path}/a/y.ids", b"abcd")  # a repeated task
    assert open(f"{tmp_path}/a/y.ids", "rb").read() == b"abcd"
    with pytest.raises(ValueError, match="not a shard"):
        packed_ids.Shard(bytes(64))
