"""SentencePiece encoding and decoding: one pass over an Aho-Corasick automaton, relaxing best scores.

The automaton holds the pieces of a SentencePiece model. Reading a text character by character, the
output links of the current state name every piece that ends there; each relaxes the best score of its
end from the best score of its start. The segmentation is therefore the one with the highest sum of piece
scores. A character that no piece covers costs a penalty below all scores and is written as its UTF-8
bytes. The text's spaces become the model's space mark, and one is put in front, as the model's
normaliser does; nothing else is changed, so decoding gives the text back.

No piece has a space mark after another character, so no piece crosses the place before a single space:
the text is cut there, and each distinct part is segmented once per worker. Texts with two marks in a
row (two spaces, or one in front) are segmented whole.

With a model of merge ranks, as the public one is, the scores are the negated ranks: the result is the
best-scored segmentation of that vocabulary, not the library's sequence of merges.

Defined results: null and empty texts have no ids; among equal scores the longer last piece wins; a text
that holds the space mark itself decodes to a space there (round_trip is false). Equal rows get equal
results; other columns are not read. Every text is taken whole, and nothing is shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.llm.frames import keyed_texts, over_batches

MARK = "▁"
PENALTY = 10.0
#: Distinct parts a worker remembers before it starts over.
CACHE_PARTS = 250_000


class Pieces:
    """A SentencePiece model's pieces as an automaton, with the parts segmented so far."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.plain = np.array([not x for x in special])
        self.scores = [sp.get_score(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if not special[i]:
                self.automaton.add_word(p, (len(p), self.scores[i], i))
        self.automaton.make_automaton()
        self.single = {p for i, p in enumerate(self.pieces) if len(p) == 1 and not special[i]}
        self.penalty = min(s for s, x in zip(self.scores, special) if not x) - PENALTY
        self.cuts = not any(MARK in p.lstrip(MARK) for i, p in enumerate(self.pieces) if not special[i])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.used = 0
        self.lengths = np.zeros(1 << 16, np.int64)
        self.begin = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def segment(self, text: str) -> list[int]:
        """The best-scored ids of a text that already has its space marks."""
        n = len(text)
        worst = float("-inf")
        best, last = [0.0] + [worst] * n, [(0, -1)] * (n + 1)
        if self.single.issuperset(text):
            for end, (size, score, piece) in self.automaton.iter(text):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1] = total
                    last[end + 1] = (size, piece)
        else:
            ends: list[list[tuple]] = [[] for _ in range(n)]
            for end, found in self.automaton.iter(text):
                ends[end].append(found)
            for end in range(n):
                for size, score, piece in ends[end]:
                    total = best[end + 1 - size] + score
                    if total > best[end + 1]:
                        best[end + 1] = total
                        last[end + 1] = (size, piece)
                if text[end] not in self.single and best[end] + self.penalty > best[end + 1]:
                    best[end + 1] = best[end] + self.penalty
                    last[end + 1] = (1, -1)
        out = []
        while n:
            size, piece = last[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            n -= size
        return out[::-1]

    def learn(self, parts: list[str]) -> None:
        gc.disable()  # very many short lists, and no cycles
        try:
            made = [self.segment(MARK + p) for p in parts]
        finally:
            gc.enable()
        n = np.fromiter(map(len, made), np.int64, len(made))
        have, total = len(self.index), int(n.sum())
        while have + len(made) > len(self.lengths):
            self.lengths, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.begin))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lengths[have : have + len(n)] = n
        self.begin[have : have + len(n)] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.used += total
        self.index.update(zip(parts, range(have, have + len(made))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > CACHE_PARTS:
            self.clear()
        cut = [[] if not t else None if not self.cuts or t[0] == " " or "  " in t or MARK in t else t.split(" ") for t in texts]
        index = self.index
        parts = list(chain.from_iterable(c for c in cut if c))
        at = np.fromiter(map(index.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys(parts[i] for i in missing)))
            at[missing] = [index[parts[i]] for i in missing]
        n = self.lengths[at]
        ends = np.cumsum(n)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - ends + n, n)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) if c else 0 for c in cut])]).astype(np.int64)]
        return [np.array(self.segment(MARK + t.replace(" ", MARK)), np.uint32) if c is None else flat[upto[i] : upto[i + 1]] for i, (t, c) in enumerate(zip(texts, cut))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, space marks as spaces."""
        if not len(ids):
            return ""
        if self.plain[ids].all():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                out.append(run.decode("utf-8", "replace"))
                run.clear()
                out.append(self.pieces[i] if self.plain[i] else "")
            text = "".join(out) + run.decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:] if text[:1] == MARK else text.replace(MARK, " ")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _in_parts(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.column(1).slice(at, rows).to_pylist()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_pieces and ids of every row; with decoded also decoded_sha256 and round_trip, of the ids decoded again."""

    def run(batch: pa.RecordBatch) -> dict:
        tool = model(path)
        ids = [x for texts in _in_parts(batch) for x in tool.encode(texts)]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int32)
        out = {"doc_id": batch.column(0), "n_pieces": n, "ids": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), flat)}
        if decoded:
            out |= {"decoded_sha256": [], "round_trip": []}
            for text, x in zip((t for texts in _in_parts(batch) for t in texts), ids):
                back = tool.decode(x)
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                out["round_trip"].append(back == (text or ""))
        return out

    return over_batches(keyed_texts(docs, id_col, text_col), run, "doc_id long, n_pieces long, ids array<int>" + ", decoded_sha256 string, round_trip boolean" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        tool = model(path)
        return {"doc_id": batch.column(0), "text": [tool.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]}

    return over_batches(keyed_texts(encoded, id_col, ids_col), run, "doc_id long, text string")


def piece_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (ids as unsigned 32-bit little-endian), decoded_sha256, round_trip."""

    def run(batch: pa.RecordBatch) -> dict:
        tool = model(path)
        out: dict = {"doc_id": batch.column(0), "n_pieces": [], "ids_crc32": [], "decoded_sha256": [], "round_trip": []}
        for texts in _in_parts(batch):
            for text, ids in zip(texts, tool.encode(texts)):
                back = tool.decode(ids)
                out["n_pieces"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                out["round_trip"].append(back == (text or ""))
        return out

    return over_batches(keyed_texts(docs, id_col, text_col), run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
