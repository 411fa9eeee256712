"""Edited license notices: what inserted, missing and turned words do to labels, against SQL written from the definition."""

from __future__ import annotations

import random

import duckdb

from frameloom.llm import license_scan, oracles
from tests.llm.data import docs_frame

NOTICES = [(t, label) for t, label in license_scan.NOTICES]


def edited(seed=5, n=260):
    """Notices with words put in, left out, swapped or doubled, among other words and other notices."""
    rng = random.Random(seed)
    filler = lambda k: ["w%d" % rng.randrange(50) for _ in range(k)]
    out = []
    for _ in range(n):
        text = filler(rng.randrange(6))
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(NOTICES)[0].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                edit = rng.randrange(4)
                if edit == 0:
                    words[at:at] = filler(rng.randrange(1, 25))
                elif edit == 1:
                    del words[at : at + rng.randrange(1, 5)]
                elif edit == 2:
                    words[at : at + 2] = words[at : at + 2][::-1]
                else:
                    words[at:at] = words[max(0, at - 4) : at]
            text += words + filler(rng.choice([0, 1, 15, 30]))
        out.append(" ".join(text))
    return out


def test_edited_notices_against_sql(spark):
    docs = docs_frame(spark, edited())
    got = license_scan.license_report(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.sql(oracles.OP9).to_arrow_table().to_pylist()
    rows = lambda x: sorted((r["doc_id"], r["labels"], r["base_labels"], r["n_base"], r["n_words"], round(r["score"], 9)) for r in x)
    assert rows(r.asDict() for r in got.collect()) == rows(want)
    assert sum(r["labels"] != r["base_labels"] for r in want) > 200  # the voting decides most of these


def test_a_license_is_not_read_into_its_relative(spark):
    nc = "licensed under a creative commons attribution noncommercial 4 0 international license"
    by = "licensed under a creative commons attribution 4 0 international license"
    texts = [nc, by, f"{nc} and parts {by}", nc.replace("4 0", "x y z 4 0")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_report(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == [("cc-by-nc", 1.0), ("cc-by", 1.0), ("cc-by,cc-by-nc", 1.0)]
    assert got[3][0] == "cc-by-nc"


def test_inserted_words_do_not_hide_a_notice(spark):
    """Every notice of 12 words or more, cut in its middle by 1 to 20 other words, keeps its label; 21 are too many unless an exact phrase is left."""
    long = [(t.split(), label) for t, label in NOTICES if len(t.split()) >= 12]
    cases = [(k, label, " ".join(w[: len(w) // 2] + ["zz%d" % j for j in range(k)] + w[len(w) // 2 :])) for w, label in long for k in range(1, 22)]
    got = {r.doc_id: r for r in license_scan.license_report(docs_frame(spark, [t for _, _, t in cases])).collect()}
    for i, (k, label, _) in enumerate(cases):
        assert (label in got[i].labels.split(",")) == (k <= 20 or bool(got[i].base_labels)), (k, label)
        assert k > 20 or got[i].score > 0.6
    bsd = next(w for w, label in long if label == "bsd")
    text = " ".join(bsd[:9] + ["a", "b", "c", "d", "e"] + bsd[9:])
    r = license_scan.license_report(docs_frame(spark, [text])).first()
    assert r.labels == "bsd" and r.score == (len(bsd) - 4) / (len(bsd) - 2)


def test_repetitive_texts(spark):
    texts = ["apache license version " * 4000, ("licensed under the apache license version 2 0 " * 1500), "the license " * 9000]
    got = {r.doc_id: r for r in license_scan.license_report(docs_frame(spark, texts)).collect()}
    assert [got[i].labels for i in range(3)] == ["", "apache-2", ""] and got[1].n_base == 1500
