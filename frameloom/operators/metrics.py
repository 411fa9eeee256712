"""Ranked metrics against a full count of annotated objects.

The denominator is always given, never derived from what was found. Ignored rows leave before ranking;
ties in score are broken by a key, because average precision depends on their order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from frameloom.functions.columns import digitize
from frameloom.operators.ordinals import placed
from frameloom.session import staged


def ranked(scored: DataFrame, by: list[str], score: str = "score", key: str = "doc_id", label: str = "label") -> DataFrame:
    """Rows that count, with rank, running tp and fp per group; rows without a group are left out.

    Groups are few and may hold most rows, and most rows may share a score; see `placed`.
    """
    rows = scored.where(F.col(label) != "ignored").withColumn("hit", (F.col(label) == "positive").cast("int"))
    rows = placed(rows, by, [F.desc(score), F.col(key)], "rank", {"tp": F.col("hit")})
    return rows.withColumn("fp", F.col("rank") - F.col("tp"))


def average_precision(scored: DataFrame, truth: DataFrame, by: list[str], score: str = "score", key: str = "doc_id", label: str = "label") -> DataFrame:
    """Per group of either side: n_gt, matched, scored, ceiling and ap; null rates where there is nothing to find."""
    each = ranked(scored, by, score, key, label).groupBy(*by).agg(
        F.sum("hit").alias("matched"), F.count("*").alias("n_scored"), F.sum(F.when(F.col("hit") == 1, F.col("tp") / F.col("rank"))).alias("gain")
    )
    return against(truth, each, by)


def against(truth: DataFrame, each: DataFrame, by: list[str]) -> DataFrame:
    """Matched, scored and summed precision per group over the full count."""
    both = truth.groupBy(*by).agg(F.count("*").alias("n_gt")).join(each, by, "full_outer")
    n_gt, zero = F.coalesce("n_gt", F.lit(0)), F.lit(0)
    return both.select(
        *by, n_gt.alias("n_gt"), F.coalesce("matched", zero).alias("matched"), F.coalesce("n_scored", zero).alias("n_scored"),
        F.when(n_gt > 0, F.coalesce("matched", zero) / n_gt).alias("ceiling"), F.when(n_gt > 0, F.coalesce("gain", F.lit(0.0)) / n_gt).alias("ap"),
    )


@F.pandas_udf(DoubleType())
def partial_gain(score: pd.Series, key: pd.Series, hit: pd.Series, rows_before: pd.Series, hits_before: pd.Series) -> float:
    """What a chunk of the ranking adds to the sum of precisions at hits, given what stands before it."""
    order = pd.DataFrame({"score": score, "key": key, "hit": hit}).sort_values(["score", "key"], ascending=[False, True], kind="stable")["hit"].to_numpy()
    tp = hits_before.iloc[0] + np.cumsum(order)
    rank = rows_before.iloc[0] + np.arange(1, len(order) + 1)
    return float((tp / rank)[order == 1].sum())


def merged_precision(scored: DataFrame, truth: DataFrame, by: list[str], score: str = "score", key: str = "doc_id", label: str = "label") -> DataFrame:
    """`average_precision` as an aggregate: each chunk of a group's ranking gives a part of its curve, and the parts are merged.

    Chunks are ranges of group, score and key, so none holds a large group, and a chunk needs of those before
    it only how many rows and hits they have.
    """
    rows = scored.where(F.col(label) != "ignored").select(*by, F.col(score).alias("_score"), F.col(key).alias("_key"), (F.col(label) == "positive").cast("int").alias("_hit"))
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    chunks = staged(rows.repartitionByRange(*by, F.desc("_score"), F.col("_key")).withColumn("_chunk", F.spark_partition_id()), "chunks")
    sizes = chunks.groupBy(*by, "_chunk").agg(F.count("*").alias("n"), F.sum("_hit").alias("hits"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("n", "hits")})
    parts = chunks.join(sizes, [*by, "_chunk"]).groupBy(*by, "_chunk").agg(partial_gain("_score", "_key", "_hit", "n_before", "hits_before").alias("gain"))
    whole = sizes.groupBy(*by).agg(F.sum("hits").alias("matched"), F.sum("n").alias("n_scored"))
    return against(truth, whole.join(parts.groupBy(*by).agg(F.sum("gain").alias("gain")), by), by)


def curve(scored: DataFrame, truth: DataFrame, by: list[str], **names) -> DataFrame:
    """Precision and recall after every rank."""
    n = truth.groupBy(*by).agg(F.count("*").alias("n_gt"))
    return ranked(scored, by, **names).join(n, by).select(*by, "rank", "tp", "fp", (F.col("tp") / F.col("rank")).alias("precision"), (F.col("tp") / F.col("n_gt")).alias("recall"))


def at_thresholds(scored: DataFrame, n_gt: DataFrame, thresholds: list, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Per group and threshold: n_selected, tp, fp, recall and precision of what scores at least the threshold."""
    rows = scored.where(F.col(label) != "ignored").withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    on = F.col(score) >= F.col("threshold")
    tp = F.count_if(on & (F.col(label) == "positive"))
    out = rows.groupBy(*by, "threshold").agg(F.count_if(on).alias("n_selected"), tp.alias("tp"))
    out = out.join(n_gt, by).withColumn("fp", F.col("n_selected") - F.col("tp"))
    return out.withColumns({"recall": F.try_divide("tp", "n_gt"), "precision": F.col("tp") / F.greatest(F.col("n_selected"), F.lit(1))})


def recall_by_band(found: DataFrame, truth: DataFrame, value: str, edges: list[float], label: str = "label") -> DataFrame:
    """Per size band: n_gt, matched and recall; every band is reported, with null recall where it is empty."""
    spark = truth.sparkSession
    band = digitize(F.col(value), F.array(*(F.lit(e) for e in edges)))
    a = truth.groupBy(band.alias("band")).agg(F.count("*").alias("n_gt"))
    b = found.where(F.col(label) == "positive").groupBy(band.alias("band")).agg(F.count("*").alias("matched"))
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("band"))
    out = every.join(a, "band", "left").join(b, "band", "left").fillna(0, ["n_gt", "matched"])
    return out.withColumn("recall", F.try_divide("matched", "n_gt"))


def single_positive(scored: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Annotated objects with more than one positive; an empty result is the condition for a valid metric."""
    return scored.where(F.col(label) == "positive").groupBy(*key).agg(F.count("*").alias("n_positive")).where("n_positive > 1")
