"""License scans by diagonal voting, with DataFrame functions only.

Every run of k words of a text is hashed and joined to the places of the same run in the license
templates; hits compare the words themselves besides their hashes. A hit at text word i and template word
j votes for the diagonal i - j, and votes are counted per text, template and diagonal. A template that stands
in the text unchanged has all its votes on one diagonal: that finds the exact phrases. Inserted or missing
words move later votes to another diagonal, so diagonals of a text and template that follow one another by at most `slack`
are merged. Merged diagonals with votes for enough different places are verified: the span is the longest chain of hits
whose places rise with the text's words and whose diagonals move by at most `slack` from hit to hit (of equally
long ones the first), and it counts from a share `coverage` of the template's runs on. A span of one label that lies inside a
span of another label with a higher share is that license's wording, not a license of its own, and goes.

Texts are scanned once: the hits, and one row for each text, are written to the shared folder, and all
counting is done on those. Templates are the fixed list of this module or a table (text, label, exact), for
instance of whole licenses. Their runs go out in blocks of at most `block_runs` rows, so the broadcast side
of the join has a fixed bound; every further block is one more scan.

Defined results: null and empty texts have no words, no labels and score 0; rows with the same id and the
same text get the same result; rows with the same id and different texts are told apart; an empty
template table finds nothing; a template of fewer than k words is an error. Columns other than the
named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.frames import keyed_texts
from frameloom.session import staged

K = 3
#: A template counts as found from this share of its word runs on (phrases: all of them).
COVERAGE = 0.6
#: Words that may be inserted or missing between one hit and the next.
SLACK = 20
#: Template runs that are broadcast at once.
BLOCK_RUNS = 100_000

# Phrases whose places are counted, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Opening or characteristic passages of well-known licenses, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
]
TEMPLATES = [(t, label, True) for t, label in PHRASES] + [(t, label, False) for t, label in NOTICES]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters that are neither letters nor digits.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_parts(text: Column) -> Column:
    """The words of a text in ASCII lower case, with an empty string where it begins or ends between words."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS)


def word_count(parts: Column) -> Column:
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def known_templates(spark: SparkSession) -> DataFrame:
    """The module's templates as a table (text, label, exact)."""
    rows = [F.struct(F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(exact).alias("exact")) for text, label, exact in TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def template_runs(templates: DataFrame, k: int) -> DataFrame:
    """(key, template, label, exact, place, n_runs, t0, t1, ...) of every run of k words; equal texts of one label are one template."""
    words = F.filter(word_parts(F.col("text")), lambda w: w != "")
    rows = templates.select("text", "label", "exact").distinct().select("label", "exact", F.xxhash64("text", "label", "exact").alias("template"), words.alias("w"))
    short = F.raise_error(F.lit(f"a template has fewer than {k} words"))
    rows = rows.withColumn("n_runs", F.when(F.size("w") >= k, F.size("w") - k + 1).otherwise(short.cast("int")))
    placed = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_runs") - 1)).alias("place"))
    placed = placed.select("template", "label", "exact", "place", "n_runs", *(F.get("w", F.col("place") + n).alias(f"t{n}") for n in range(k)))
    return placed.withColumn("key", F.xxhash64(*(f"t{n}" for n in range(k))))


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, k: int = K, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """The written table (doc_id, version, n_words, i, template, label, exact, n_runs, place) of all hits, and a row without a template for each row of docs."""
    if templates is None:
        runs, n = template_runs(known_templates(docs.sparkSession), k), 0
    else:
        runs = staged(template_runs(templates, k), "template-runs", small=True)
        n = runs.count()
    parts = keyed_texts(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), word_parts(F.col("text")).alias("parts"))
    parts = parts.withColumn("n_words", word_count(F.col("parts")))
    # the first element is no word but stands for the row itself
    every = parts.select("doc_id", "version", "n_words", "parts", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("parts"))).alias("at", "w0"))
    words = every.select("doc_id", "version", "n_words", "at", (F.col("at") - 1 - F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)).alias("i"), "w0", *(F.get("parts", F.col("at") - 1 + j).alias(f"w{j}") for j in range(1, k)))
    keyed = words.withColumn("key", F.when(F.col("at") > 0, F.xxhash64(*(f"w{j}" for j in range(k)))))
    own = F.col("at") == 0
    same = F.lit(True)
    for j in range(k):
        same = same & (F.col(f"w{j}") == F.col(f"t{j}"))
    out = []
    n_blocks = max(1, -(-n // block_runs))
    for b in range(n_blocks):
        block = runs if n_blocks == 1 else runs.where(F.pmod(F.xxhash64("template", "place"), F.lit(n_blocks)) == b)
        # only the hash is a join key; the words are compared where it is equal
        joined = keyed.join(F.broadcast(block), "key", "left").where(F.coalesce(same, F.lit(False)) | (own if b == 0 else F.lit(False)))
        out.append(staged(joined.select("doc_id", "version", "n_words", "i", "template", "label", "exact", "n_runs", "place"), f"license-hits-{b}"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def once(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def longest_chain(hits: Column, n_runs: Column, slack: int) -> Column:
    """(n, first, last): the longest chain of hits (i, place) in the text's order, and the text words of its ends."""
    chain = "struct<i:bigint,back:bigint,n:bigint,first:bigint>"
    turned = F.array_sort(F.transform(hits, lambda h: F.struct(h["i"].cast("long").alias("i"), (-h["place"]).cast("long").alias("back"))))
    none = F.lit(0).cast("long")
    start = F.struct(F.struct(none.alias("n"), none.alias("first"), none.alias("last")).alias("best"), F.array().cast(f"array<{chain}>").alias("recent"))

    def step(a: Column, h: Column) -> Column:
        before = F.filter(a["recent"], lambda r: (r["i"] < h["i"]) & (r["back"] > h["back"]) & (F.abs(h["i"] + h["back"] - r["i"] - r["back"]) <= slack))
        most = F.array_max(F.transform(before, lambda r: F.struct(r["n"].alias("n"), (-r["first"]).alias("later"))))
        end = once(most, lambda m: F.struct((F.coalesce(m["n"], none) + 1).alias("n"), F.coalesce(-m["later"], h["i"]).alias("first")))
        # a hit further back than the template's length and the slack cannot be the one before
        recent = F.filter(a["recent"], lambda r: h["i"] - r["i"] <= n_runs + slack)
        better = lambda e: (e["n"] > a["best"]["n"]) | ((e["n"] == a["best"]["n"]) & (e["first"] < a["best"]["first"]))
        best = lambda e: F.when(better(e), F.struct(e["n"].alias("n"), e["first"].alias("first"), h["i"].alias("last"))).otherwise(a["best"])
        here = lambda e: F.struct(h["i"].alias("i"), h["back"].alias("back"), e["n"].alias("n"), e["first"].alias("first"))
        return once(end, lambda e: F.struct(best(e).alias("best"), F.concat(recent, F.array(here(e))).alias("recent")))

    return F.aggregate(turned, start, step, lambda a: a["best"])


#: What tells the rows of one text and template.
OF_TEMPLATE = ("doc_id", "version", "template", "label", "exact", "n_runs")


def diagonals(scanned: DataFrame) -> DataFrame:
    """(OF_TEMPLATE, diagonal, hits, n_votes): the votes of each diagonal, one for each place, however often a row is repeated."""
    votes = scanned.where("template IS NOT NULL").withColumn("diagonal", (F.col("i") - F.col("place")).cast("long"))
    dealt = votes.repartition("doc_id", "version", "template")  # for this and the steps after it
    return dealt.groupBy(*OF_TEMPLATE, "diagonal").agg(F.collect_set(F.struct("i", "place")).alias("hits")).withColumn("n_votes", F.size("hits"))


def found(scanned: DataFrame, slack: int = SLACK, coverage: float = COVERAGE, k: int = K) -> DataFrame:
    """(doc_id, version, template, label, exact, start, stop, share): places of templates in a table of hits, the end exclusive.

    Exact templates give one row per diagonal that has every vote; others one per merged diagonals whose
    verified span has at least the share `coverage` of the template and is no part of another license.
    """
    votes = diagonals(scanned)
    whole = votes.where(F.col("exact") & (F.col("n_votes") == F.col("n_runs")))
    phrases = whole.select("doc_id", "version", "template", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_runs") + k - 1).alias("stop"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order) > slack
    near = votes.where(~F.col("exact")).withColumn("new", F.coalesce(gap.cast("int"), F.lit(0)))
    merged = near.withColumn("cluster", F.sum("new").over(order)).groupBy(*OF_TEMPLATE, "cluster").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    n_places = F.size(F.array_distinct(F.transform("hits", lambda h: h["place"])))
    chain = F.when(n_places >= coverage * F.col("n_runs"), longest_chain(F.col("hits"), F.col("n_runs"), slack))
    spans = merged.withColumn("chain", chain).withColumn("share", F.col("chain.n") / F.col("n_runs")).where(F.col("share") >= coverage)
    spans = spans.select("doc_id", "version", "template", "label", "exact", F.col("chain.first").alias("start"), (F.col("chain.last") + k).alias("stop"), "share")
    # the spans of one text, which are further apart than the slack if they are of one template
    together = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("template", "label", "exact", "start", "stop", "share")).alias("s"))
    part_of = lambda a, b: (a["label"] != b["label"]) & (a["share"] < b["share"]) & (a["start"] >= b["start"]) & (a["stop"] <= b["stop"])
    kept = together.select("doc_id", "version", F.inline(F.filter("s", lambda a: ~F.exists("s", lambda b: part_of(a, b)))))
    return phrases.unionByName(kept)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, k: int = K, block_runs: int = BLOCK_RUNS, **how) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns count the exact templates.
    """
    scanned = hits(docs, id_col, text_col, templates, k, block_runs)
    exact = F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_doc = found(scanned, k=k, **how).groupBy(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version")).agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    return scanned.where("template IS NULL").join(per_doc, same, "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
