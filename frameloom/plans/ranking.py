"""Queries over ranked proposals, samples and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import aggregates as A
from frameloom.operators import joins as J
from frameloom.operators import metrics as X
from frameloom.operators import sampling as S
from frameloom.plans.views import duck, view

R6 = lambda c: F.round(c, 6)
D = duck("scored", "truth")
RANKED = """ranked AS (SELECT *, sum(hit) OVER (PARTITION BY grp ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT *, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS hit FROM scored WHERE label <> 'ignored'))"""


def ap_by_group(spark, d):
    """A-17, A-18, A-19, A-20, O-2, FLT-6: average precision per group against the full count."""
    a = X.average_precision(view(spark, d, "scored"), view(spark, d, "truth"), ["grp"])
    return a.select("grp", "n_gt", "matched", "n_scored", R6("ceiling").alias("ceiling"), R6("ap").alias("ap"))


def merged_ap(spark, d):
    """A-19: the same from an aggregate over chunks of the ranking whose curves are merged."""
    a = X.merged_precision(view(spark, d, "scored"), view(spark, d, "truth"), ["grp"])
    return a.select("grp", "n_gt", "matched", "n_scored", R6("ceiling").alias("ceiling"), R6("ap").alias("ap"))


def pr_curve(spark, d):
    """W-7: running precision and recall."""
    c = X.curve(view(spark, d, "scored"), view(spark, d, "truth"), ["grp"])
    return c.select("grp", F.col("rank").cast("long").alias("rank"), "tp", "fp", R6("precision").alias("precision"), R6("recall").alias("recall"))


def thresholds(spark, d):
    """A-21: recall and precision at score thresholds."""
    n = view(spark, d, "truth").groupBy("grp").agg(F.count("*").alias("n_gt"))
    t = X.at_thresholds(view(spark, d, "scored"), n, [500, 1000, 2000, 4000], ["grp"])
    return t.select("grp", "threshold", "n_selected", "tp", "n_gt", "fp", R6("recall").alias("recall"), R6("precision").alias("precision"))


def size_recall(spark, d):
    """A-22: recall per size band with empty bands reported."""
    found = view(spark, d, "scored")
    r = X.recall_by_band(found.withColumn("n_chars", F.col("score")), view(spark, d, "truth"), "n_chars", [400, 1000, 2000, 4000, 10**9])
    return r.select("band", "n_gt", "matched", R6("recall").alias("recall"))


def labelled_docs(spark, d):
    return view(spark, d, "documents").join(view(spark, d, "labels"), "doc_id")


EDGES = (500.0, 1000.0, 2000.0, 4000.0)


def draw(spark, d):
    """S-2, B-2, SNK-8: stratified draw of negatives per band and group, three seeds, hash order."""
    docs = labelled_docs(spark, d).withColumn("band", C.digitize(F.col("n_chars").cast("double"), F.array(*map(F.lit, EDGES))))
    rows, _ = S.stratified(docs.where("toxic = 0"), docs.where("toxic = 1"), ["lang", "band"], 2.0, [1, 2, 3], ["doc_id"])
    return rows.select("seed", "lang", "band", "doc_id")


def draw_cells(spark, d):
    """S-2: quota, availability and shortfall of every cell with positives."""
    docs = labelled_docs(spark, d).withColumn("band", C.digitize(F.col("n_chars").cast("double"), F.array(*map(F.lit, EDGES))))
    _, cells = S.stratified(docs.where("toxic = 0"), docs.where("toxic = 1"), ["lang", "band"], 20.0, [1], ["doc_id"])
    return cells


def decile_counts(spark, d):
    """B-1: rows per decile of the labelled documents' length."""
    docs = view(spark, d, "documents")
    edges = S.deciles(labelled_docs(spark, d), "n_chars")
    return docs.groupBy(C.digitize(F.col("n_chars").cast("double"), edges).alias("band")).agg(F.count("*").alias("n"))


def concentration(spark, d):
    """A-29: shares of the largest sources per language."""
    c = A.concentration(view(spark, d, "documents"), ["lang"], "source")
    return c.select("lang", "n_rows", "n_members", R6("top2_share").alias("top2_share"), R6("top5_share").alias("top5_share"))


def fixed_share(spark, d):
    """S-3: a fixed share of every source, at least one row, in hash order."""
    return S.share_of_each(view(spark, d, "documents"), ["source"], 0.05, 11, ["doc_id"]).select("source", "doc_id")


def capped(spark, d):
    """W-14, S-4: at most six rows per language, one per source before a second one."""
    return S.capped(view(spark, d, "documents"), ["lang"], "source", 6, 5, ["doc_id"], per_member=2).select("lang", "source", "doc_id")


def borrowed(spark, d):
    """S-5: every unlabelled document with the size of a labelled one of its language."""
    docs = view(spark, d, "documents")
    sizes = labelled_docs(spark, d).select("lang", F.col("n_chars").alias("size"), F.col("doc_id").alias("size_id"))
    rows = docs.join(view(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")
    return S.borrowed(rows, sizes, ["lang"], 9, ["doc_id"], ["size"], ["size_id"])


def repeats(spark, d):
    """S-6, W-13: a tenth of the rows to be scored again, numbered in draw order."""
    return S.repeats(view(spark, d, "labels").select("doc_id"), 0.1, 3, ["doc_id"])


# reviews of documents: usability, a call and a cue, made from the labels
REVIEWS = """SELECT l.doc_id, d.lang, CASE l.doc_id % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'not_usable' ELSE 'cannot_tell' END AS score,
  CASE WHEN l.doc_id % 5 = 0 THEN '' WHEN l.doc_id % 5 = 1 THEN 'undecided' WHEN l.toxic = 1 THEN 'object' ELSE 'background' END AS call,
  CASE WHEN l.quality = 1 THEN 'object' ELSE 'background' END AS truth,
  CASE l.doc_id % 6 WHEN 0 THEN 'motion' WHEN 1 THEN 'Appearance ' WHEN 2 THEN 'shape' ELSE '' END AS cue,
  CASE l.doc_id % 7 WHEN 0 THEN 'by motion' WHEN 1 THEN 'appearance only' ELSE '' END AS note,
  CASE WHEN l.doc_id % 3 = 0 THEN 'AB' WHEN l.doc_id % 3 = 1 THEN 'A' ELSE 'B' END AS condition, l.doc_id % 8 AS frames
  FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"""
REVIEW_SQL = f"WITH reviews AS ({REVIEWS.format(labels='labels', documents='documents')})"


def reviews(spark, d):
    return spark.sql(REVIEWS, labels=view(spark, d, "labels"), documents=view(spark, d, "documents"))


def confusion(spark, d):
    """A-23: confusion of true class and call, accuracy over decided calls."""
    c = A.confusion(reviews(spark, d).where("call <> ''"), "truth", "call", ["object", "background"], ["object", "background", "undecided"], "undecided")
    return c.select("truth", "object", "background", "undecided", "decided", "right", R6("accuracy").alias("accuracy"))


def cues(spark, d):
    """PRJ-8: cue repair with provenance."""
    r = reviews(spark, d).withColumn("fixed", C.repaired_cue(F.col("call"), F.col("cue"), F.col("note")))
    return r.select("doc_id", F.col("fixed.cue").alias("cue"), F.col("fixed.provenance").alias("provenance"))


def frequency(spark, d):
    """A-8: usability per language with a fixed list of values."""
    return A.table_of(reviews(spark, d), "lang", "score", list(C.SCORE_ORDER))


def paired_scores(spark, d):
    """J-11, PRJ-11, A-24: scores of both ends of a mapping, and the sign of their difference."""
    r = reviews(spark, d)
    mapping = r.select(F.col("doc_id").alias("repeat_id"), (F.col("doc_id") + 1).alias("original_id"))
    p = J.paired(mapping, r, "repeat_id", "original_id", "doc_id", "score")
    sign = F.signum(C.score_rank(F.col("first_value")) - C.score_rank(F.col("second_value"))).cast("int")
    return p.select("repeat_id", "original_id", "first_value", "second_value", sign.alias("direction"))


def agreement(spark, d):
    """A-24: intra-rater agreement."""
    r = reviews(spark, d)
    mapping = r.select(F.col("doc_id").alias("repeat_id"), (F.col("doc_id") + 4).alias("original_id"))
    return A.agreement(J.paired(mapping, r, "repeat_id", "original_id", "doc_id", "score"), "first_value", "second_value")


def condition_cells(spark, d):
    """A-25: usable rows per condition, the joint one counted in both."""
    return A.condition_table(reviews(spark, d), "lang", "condition", F.col("score") == "usable")


def yields(spark, d):
    """A-26: mean usable frames with unknown ones left out."""
    rows = reviews(spark, d).withColumn("frames", F.nullif("frames", F.lit(5)))
    y = A.usable_yield(rows.withColumn("length", F.lit(8)), ["lang"], "score", "frames", "length")
    return y.select("lang", "n", R6("mean_frames").alias("mean_frames"))


def unscored(spark, d):
    """FLT-9: reviews without a call."""
    return reviews(spark, d).where(F.length(F.trim("call")) == 0).select("doc_id", "lang")


def twins(spark, d):
    """J-10: each reviewed row with its first twin on equal columns."""
    r = reviews(spark, d)
    return J.twins(r, ["lang", "truth", "score"], F.col("condition") == "A", F.col("condition") == "B", "doc_id")


def spread(spark, d):
    """A-4, A-36: spread of a score per group over an expected grid, missing runs counted."""
    grid = view(spark, d, "documents").select("doc_id", "lang")
    runs = view(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("value"), F.lit(1.0).alias("ceiling"))
    c = A.collated(grid, runs, ["doc_id"], "lang", "value", "ceiling")
    return c.select("lang", "n_runs", "n_missing", *(R6(x).alias(x) for x in ("mean", "sd", "min", "max", "ceiling", "headroom")))


CELLS = """docs AS (SELECT d.doc_id, lang, toxic, CAST(len([e FOR e IN [500, 1000, 2000, 4000] IF e <= n_chars]) AS int) AS band FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  wanted AS (SELECT lang, band, count(*) AS n_wanted FROM docs WHERE toxic = 1 GROUP BY ALL)"""
HASH = "md5(concat_ws('|', '{seed}', CAST(doc_id AS varchar)))"
AP = f"""{D}, {RANKED}, r AS (SELECT grp, CAST(sum(hit) AS bigint) AS matched, count(*) AS n_scored, sum(CASE WHEN hit = 1 THEN tp / rank END) AS gain FROM ranked GROUP BY grp), t AS (SELECT grp, count(*) AS n_gt FROM truth GROUP BY grp)
      SELECT coalesce(t.grp, r.grp) AS grp, coalesce(n_gt, 0) AS n_gt, coalesce(matched, 0) AS matched, coalesce(n_scored, 0) AS n_scored, round(coalesce(matched, 0) / nullif(n_gt, 0), 6) AS ceiling, round(coalesce(gain, 0) / nullif(n_gt, 0), 6) AS ap FROM t FULL JOIN r ON t.grp = r.grp"""

QUERIES = {
    "ap_by_group": (ap_by_group, AP),
    "merged_ap": (merged_ap, AP),
    "pr_curve": (pr_curve, f"""{D}, {RANKED}, t AS (SELECT grp, count(*) AS n_gt FROM truth GROUP BY grp) SELECT grp, rank, CAST(tp AS bigint) AS tp, CAST(rank - tp AS bigint) AS fp, round(tp / rank, 6) AS precision, round(tp / n_gt, 6) AS recall FROM ranked JOIN t USING (grp)"""),
    "recall_at_score": (thresholds, f"""{D}, t AS (SELECT grp, count(*) AS n_gt FROM truth GROUP BY grp), s AS (SELECT grp, threshold, count(*) FILTER (score >= threshold) AS n_selected, count(*) FILTER (score >= threshold AND label = 'positive') AS tp
      FROM scored, (SELECT unnest([500, 1000, 2000, 4000]) AS threshold) WHERE label <> 'ignored' GROUP BY ALL) SELECT grp, threshold, n_selected, tp, n_gt, n_selected - tp AS fp, round(tp / n_gt, 6) AS recall, round(tp / greatest(n_selected, 1), 6) AS precision FROM s JOIN t USING (grp)"""),
    "recall_by_size": (size_recall, f"""{D}, e AS (SELECT [400, 1000, 2000, 4000, 1000000000] AS e), t AS (SELECT CAST(len([x FOR x IN e IF x <= n_chars]) AS int) AS band, count(*) AS n_gt FROM truth, e GROUP BY ALL),
      m AS (SELECT CAST(len([x FOR x IN e IF x <= score]) AS int) AS band, count(*) AS matched FROM scored, e WHERE label = 'positive' GROUP BY ALL)
      SELECT band, coalesce(n_gt, 0) AS n_gt, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / nullif(n_gt, 0), 6) AS recall FROM (SELECT CAST(unnest(range(6)) AS int) AS band) LEFT JOIN t USING (band) LEFT JOIN m USING (band)"""),
    "stratified_draw": (draw, f"""WITH {CELLS} SELECT seed, lang, band, doc_id FROM (SELECT seed, d.lang, d.band, doc_id, n_wanted, row_number() OVER (PARTITION BY seed, d.lang, d.band ORDER BY md5(concat_ws('|', CAST(seed AS varchar), CAST(doc_id AS varchar))), doc_id) AS r
      FROM docs d JOIN wanted w ON w.lang = d.lang AND w.band = d.band, (SELECT unnest([1, 2, 3]) AS seed) WHERE toxic = 0) WHERE r <= floor(n_wanted * 2)"""),
    "draw_cells": (draw_cells, f"""WITH {CELLS}, have AS (SELECT lang, band, count(*) AS available FROM docs WHERE toxic = 0 GROUP BY ALL) SELECT lang, band, n_wanted, n_wanted * 20 AS quota, coalesce(available, 0) AS available, least(n_wanted * 20, coalesce(available, 0)) AS drawn, greatest(n_wanted * 20 - coalesce(available, 0), 0) AS shortfall
      FROM wanted LEFT JOIN have USING (lang, band)"""),
    "decile_bands": (decile_counts, """WITH e AS (SELECT quantile_cont(n_chars::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM documents JOIN labels USING (doc_id)) SELECT CAST(len([x FOR x IN e IF x <= n_chars]) AS int) AS band, count(*) AS n FROM documents, e GROUP BY ALL"""),
    "concentration": (concentration, """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM c)
      SELECT lang, CAST(sum(n) AS bigint) AS n_rows, count(*) AS n_members, round(sum(n) FILTER (k <= 2) / sum(n), 6) AS top2_share, round(sum(n) FILTER (k <= 5) / sum(n), 6) AS top5_share FROM r GROUP BY lang"""),
    "fixed_share": (fixed_share, f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH.format(seed=11)}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= greatest(1, least(round_even(n * 0.05::DOUBLE, 0), n))"""),
    "capped_sample": (capped, f"""WITH t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {HASH.format(seed=5)}, doc_id) AS turn FROM documents) SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, {HASH.format(seed=6)}, doc_id) AS r FROM t WHERE turn <= 2) WHERE r <= 6"""),
    "borrowed_sizes": (borrowed, f"""WITH s AS (SELECT lang, n_chars AS size, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
      r AS (SELECT doc_id, lang, CAST(('0x' || substr({HASH.format(seed=9)}, 1, 12)) AS bigint) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT r.doc_id, r.lang, size FROM r JOIN s ON s.lang = r.lang AND s.k = r.h % s.n"""),
    "repeat_sample": (repeats, f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH.format(seed=3)}, doc_id) AS k, count(*) OVER () AS n FROM labels) SELECT doc_id, 'R' || lpad(CAST(k AS varchar), 3, '0') AS repeat_id FROM o WHERE k <= greatest(1, round_even(n * 0.1::DOUBLE, 0))"""),
    "confusion": (confusion, f"""{REVIEW_SQL} SELECT truth, count(*) FILTER (call = 'object') AS object, count(*) FILTER (call = 'background') AS background, count(*) FILTER (call = 'undecided') AS undecided, count(*) FILTER (call <> 'undecided') AS decided, count(*) FILTER (call = truth) AS right,
      round(count(*) FILTER (call = truth) / nullif(count(*) FILTER (call <> 'undecided'), 0), 6) AS accuracy FROM reviews WHERE call <> '' GROUP BY truth"""),
    "cue_repair": (cues, f"""{REVIEW_SQL}, c AS (SELECT doc_id, call, lower(trim(cue)) AS cue, CASE WHEN contains(note, 'appearance') THEN 'appearance' WHEN contains(note, 'motion') THEN 'motion' WHEN contains(note, 'both') THEN 'both' ELSE '' END AS named FROM reviews),
      k AS (SELECT *, cue IN ('appearance', 'motion', 'both') AS known FROM c) SELECT doc_id, CASE WHEN call = '' THEN '' WHEN known AND named <> '' AND named <> cue THEN '' WHEN known THEN cue WHEN cue = '' AND named <> '' THEN named ELSE '' END AS cue,
      CASE WHEN call = '' THEN 'unscored' WHEN known AND named <> '' AND named <> cue THEN 'conflict' WHEN known THEN 'recorded' WHEN cue = '' AND named <> '' THEN 'note' WHEN cue <> '' THEN 'unknown' WHEN call = 'background' THEN 'not_needed' ELSE 'missing' END AS provenance FROM k"""),
    "score_table": (frequency, f"""{REVIEW_SQL} SELECT lang, count(*) FILTER (score = 'cannot_tell') AS cannot_tell, count(*) FILTER (score = 'not_usable') AS not_usable, count(*) FILTER (score = 'degraded') AS degraded, count(*) FILTER (score = 'usable') AS usable, count(*) AS total FROM reviews GROUP BY lang"""),
    "paired_scores": (paired_scores, f"""{REVIEW_SQL}, o AS (SELECT doc_id, score, list_position(['cannot_tell', 'not_usable', 'degraded', 'usable'], score) AS k FROM reviews)
      SELECT a.doc_id AS repeat_id, a.doc_id + 1 AS original_id, a.score AS first_value, b.score AS second_value, CAST(sign(a.k - b.k) AS int) AS direction FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id + 1"""),
    "agreement": (agreement, f"{REVIEW_SQL} SELECT count(*) FILTER (b.score IS NOT NULL) AS n_pairs, count(*) FILTER (a.score = b.score) AS n_agree FROM reviews a LEFT JOIN reviews b ON b.doc_id = a.doc_id + 4"),
    "condition_cells": (condition_cells, f"{REVIEW_SQL}, p AS (SELECT lang, score, unnest(CASE WHEN condition = 'AB' THEN ['A', 'B'] ELSE [condition] END) AS part FROM reviews) SELECT lang, part, count(*) AS n, count(*) FILTER (score = 'usable') AS n_usable FROM p GROUP BY ALL"),
    "usable_yield": (yields, f"{REVIEW_SQL}, v AS (SELECT lang, CASE WHEN score = 'usable' THEN 8 WHEN score = 'degraded' THEN nullif(frames, 5) ELSE 0 END AS v FROM reviews) SELECT lang, count(v) AS n, round(avg(v), 6) AS mean_frames FROM v GROUP BY lang"),
    "unscored": (unscored, f"{REVIEW_SQL} SELECT doc_id, lang FROM reviews WHERE call = ''"),
    "twin_rows": (twins, f"{REVIEW_SQL} SELECT a.doc_id, min(b.doc_id) AS twin FROM reviews a JOIN reviews b ON a.lang = b.lang AND a.truth = b.truth AND a.score = b.score WHERE a.condition = 'A' AND b.condition = 'B' GROUP BY a.doc_id"),
    "run_collation": (spread, """SELECT lang, count(quality) AS n_runs, count(*) FILTER (quality IS NULL) AS n_missing, round(avg(quality), 6) AS mean, round(stddev_samp(quality), 6) AS sd, round(min(quality)::DOUBLE, 6) AS min, round(max(quality)::DOUBLE, 6) AS max, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE END), 6) AS ceiling,
      round(avg(quality) / avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE END), 6) AS headroom FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang"""),
}
