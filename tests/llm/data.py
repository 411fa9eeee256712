"""Small tables with awkward rows, and plain definitions to hold the operators against."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, version long, node string, score double"


def docs_frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t), 7, "x", 0.5) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " ", "\n", "word", "a b c d", "a b c d e", "é ü\tß\r\n\x0bq", "x" * 30_000, "long " * 8_000, "日本語 テスト", "﻿ odd   line", "tab\tand  two  spaces   three"]

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = [x for x in SPACES.split(lowered(text)) if x]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
