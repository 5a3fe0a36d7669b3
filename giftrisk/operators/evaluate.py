"""Exact evaluation of a score against a 0/1 label.

Rows are first collapsed to one row per (group, distinct score) with the
positive / negative counts at that score (map-side partial aggregation). Curves
need running totals in descending score order: the distinct scores are written
range-partitioned by score, each range is one window partition, and a range's
offset comes from the totals of the ranges above it (one row per range).

* ROC AUC = sum over scores of fp_at * (tp_above + tp_at / 2) / (P * N)
  (ties count half, as the trapezoid / Mann-Whitney form);
* AP = sum over scores of (tp_at / P) * precision(score);
* F-beta argmax over the precision-recall points, lowest threshold on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.session import write_stage

#: Distinct scores that one task orders.
RANGE_SCORES = 100_000


def score_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., score, tp_at, fp_at): one row per distinct score."""
    by = by or []
    y = F.col(label)
    return (df.where(F.col(score).isNotNull())
            .groupBy(*by, F.col(score).alias("score"))
            .agg(F.sum(y).cast("bigint").alias("tp_at"), F.sum(1 - y).cast("bigint").alias("fp_at")))


def running_totals(g: DataFrame, by: list[str], ranges: int | None = None) -> DataFrame:
    """Adds cum_tp / cum_fp (score >= this score) and P / N per group. ``ranges``:
    number of score ranges (by default one for each ``RANGE_SCORES``, so that a task's
    share does not grow with the table)."""
    down = F.col("score").desc()
    g = write_stage(g, "scores")  # the range bounds come from a pass of their own
    g = g.repartitionByRange(ranges or 1 + g.count() // RANGE_SCORES, down)
    g = write_stage(g.withColumn("_b", F.spark_partition_id()), "score_ranges")  # fixes the numbers
    keys = by + ["_b"]
    totals = g.groupBy(*keys).agg(F.sum("tp_at").alias("_btp"), F.sum("fp_at").alias("_bfp"))
    above = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *keys,
        F.coalesce(F.sum("_btp").over(above), F.lit(0)).alias("_otp"),
        F.coalesce(F.sum("_bfp").over(above), F.lit(0)).alias("_ofp"),
        F.sum("_btp").over(whole).alias("P"), F.sum("_bfp").over(whole).alias("N"))
    w = Window.partitionBy(*keys).orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
    # a row per range; broadcast the other way round, all scores would meet in the totals' few tasks
    return (g.join(F.broadcast(totals), keys).withColumn("cum_tp", F.col("_otp") + F.sum("tp_at").over(w))
            .withColumn("cum_fp", F.col("_ofp") + F.sum("fp_at").over(w))
            .drop("_b", "_otp", "_ofp"))


def pr_points(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Precision-recall points per distinct threshold, down to the first
    threshold reaching full recall (as the usual curve is truncated), and the end
    point (recall 0, precision 1), which has no threshold."""
    by = by or []
    counts = score_counts(df, score, label, by)
    c = running_totals(counts, by)
    points = (c.where((F.col("cum_tp") - F.col("tp_at")) < F.col("P"))
              .select(*by, F.col("score").alias("threshold"), "cum_tp", "cum_fp", "tp_at", "P", "N",
                      (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                      (F.col("cum_tp") / F.col("P")).alias("recall")))
    zero = F.lit(0).cast("bigint")
    end = counts.groupBy(*by).agg(F.sum("tp_at").alias("P"), F.sum("fp_at").alias("N")).where("P is not null").select(
        *by, F.lit(None).cast("double").alias("threshold"), zero.alias("cum_tp"), zero.alias("cum_fp"), zero.alias("tp_at"),
        "P", "N", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def roc_points(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """ROC points per distinct threshold, and (0, 0), which has no threshold."""
    by = by or []
    counts = score_counts(df, score, label, by)
    c = running_totals(counts, by)
    points = c.select(*by, F.col("score").alias("threshold"),
                      (F.col("cum_fp") / F.col("N")).alias("fpr"), (F.col("cum_tp") / F.col("P")).alias("tpr"))
    end = counts.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0").select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(end)


def summary_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None,
                    beta: float = 0.5) -> DataFrame:
    """Per group: roc_auc, average_precision, base_rate and the F-beta optimal
    threshold with its precision / recall / F-beta."""
    by = by or []
    c = running_totals(score_counts(df, score, label, by), by)
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    rec = F.col("cum_tp") / F.col("P")
    b2 = beta * beta
    denom = F.lit(b2) * prec + rec
    fbeta = F.when(denom > 0, (1 + b2) * prec * rec / denom).otherwise(F.lit(0.0))
    on_curve = (F.col("cum_tp") - F.col("tp_at")) < F.col("P")
    c = c.withColumns({"_prec": prec, "_rec": rec, "_fb": fbeta})
    best = F.max_by(F.struct(F.col("score"), F.col("_prec"), F.col("_rec"), F.col("_fb")),
                    F.when(on_curve, F.struct(F.col("_fb"), -F.col("score"))))
    agg = c.groupBy(*by).agg(
        (F.sum(F.col("fp_at") * (F.col("cum_tp") - F.col("tp_at") / 2.0)) / (F.first("P") * F.first("N")))
        .alias("roc_auc"),
        F.sum(F.col("tp_at") / F.col("P") * F.col("_prec")).alias("average_precision"),
        (F.first("P") / (F.first("P") + F.first("N"))).alias("base_rate"),
        best.alias("_best"))
    return agg.select(*by, "roc_auc", "average_precision", "base_rate",
                      F.col("_best.score").alias("opt_threshold"), F.col("_best._prec").alias("opt_precision"),
                      F.col("_best._rec").alias("opt_recall"), F.col("_best._fb").alias("opt_fbeta"))


def confusion(df: DataFrame, score: Column, label: str, threshold: Column | float,
              by: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP and class-1 precision / recall / F1 at a
    threshold (score >= threshold predicts 1)."""
    by = by or []
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pred = (score >= t).cast("int")
    y = F.col(label)
    agg = df.groupBy(*by).agg(
        F.count_if((pred == 0) & (y == 0)).alias("tn"), F.count_if((pred == 1) & (y == 0)).alias("fp"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"), F.count_if((pred == 1) & (y == 1)).alias("tp"))
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(*by, "tn", "fp", "fn", "tp",
                      F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"),
                      F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def threshold_sweep(df: DataFrame, score: str, label: str, lo: int = 10, hi: int = 90,
                    by: list[str] | None = None) -> DataFrame:
    """V9: confusion counts at thresholds lo/100 .. hi/100. Each row goes to
    the bucket k = largest integer with k/100 <= score; a running sum over the
    <= 101 buckets per group gives every threshold, with no cross product."""
    by = by or []
    s = F.col(score)
    k0 = F.floor(s * 100)
    k = (F.when(s >= (k0 + 1) / 100.0, k0 + 1).when(s < k0 / 100.0, k0 - 1).otherwise(k0))
    k = F.least(F.greatest(k, F.lit(lo - 1)), F.lit(hi))
    y = F.col(label)
    b = (df.where(s.isNotNull()).groupBy(*by, k.cast("int").alias("k"))
         .agg(F.sum(y).cast("bigint").alias("tp_b"), F.sum(1 - y).cast("bigint").alias("fp_b")))
    w_desc = Window.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = b.select(*by, "k", F.sum("tp_b").over(w_desc).alias("tp"), F.sum("fp_b").over(w_desc).alias("fp"))
    # one grid row per (group, threshold) even when no score falls in a bucket;
    # the grid is generated per group (no join product), running totals are
    # carried down with a last-value fill.
    totals = b.groupBy(*by).agg(F.sum("tp_b").alias("P"), F.sum("fp_b").alias("N"))
    grid = totals.select(*by, "P", "N", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k"))
    full = grid.join(c, by + ["k"], "left")
    fill = Window.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.coalesce(F.last("tp", ignorenulls=True).over(fill), F.lit(0).cast("bigint"))
    fp = F.coalesce(F.last("fp", ignorenulls=True).over(fill), F.lit(0).cast("bigint"))
    full = full.select(*by, "k", tp.alias("tp"), fp.alias("fp"), "P", "N")
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("P"))
    return full.select(*by, (F.col("k") / 100.0).alias("threshold"), "tp", "fp",
                       (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
                       F.coalesce(prec, F.lit(0.0)).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"))
