"""Scoring and triage: partner-signal boost (T-b), fired-rule explanations
(T-c), risk tiers (T-a), recommended action (T-e), tier breakdown (T-f / A27)
and the triage queue (T-g / L1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators.features import Anchors, near_threshold


def partner_boost(df: DataFrame | None = None) -> Column:
    """Banking-partner boost: CVV fail, device status, webhook event."""
    cvv = F.when(F.col("CVV_Check") == "Fail", F.lit(C.BOOST_CVV_FAIL)).otherwise(F.lit(0.0))
    dev = F.lit(0.0)
    for status, w in C.BOOST_DEVICE.items():
        dev = F.when(F.col("Device_Fingerprint") == status, F.lit(w)).otherwise(dev)
    hook = F.lit(0.0)
    for event, w in C.BOOST_WEBHOOK.items():
        hook = F.when(F.col("Webhook_Event") == event, F.lit(w)).otherwise(hook)
    return cvv + dev + hook


def boosted_score(base: Column) -> Column:
    """min(model score + boost, 1)."""
    return F.least(base + partner_boost(), F.lit(1.0))


def risk_tier(score: Column) -> Column:
    """Left-closed bands: [0,.3) Low, [.3,.6) Medium, [.6,.8) High, [.8,1] Critical."""
    expr = None
    for name, lo in reversed(C.TIERS[1:]):
        expr = F.when(score >= F.lit(lo), F.lit(name)) if expr is None else expr.when(score >= F.lit(lo), F.lit(name))
    return F.when(score.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(C.TIERS[0][0])))


def tier_rank(tier: Column) -> Column:
    m = F.create_map(*[x for i, t in enumerate(C.TIER_ORDER) for x in (F.lit(t), F.lit(i))])
    return m[tier]


def recommended_action(tier: Column) -> Column:
    m = F.create_map(*[x for k, v in C.TIER_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return m[tier]


# FIXED VALUES: explanation titles of the single-donation scorer
EXPLANATIONS = [
    "Night-time large transfer",
    "High-risk platform + large amount",
    "Donation far exceeds account balance",
    "Low balance + large gift",
    "Large round-number amount",
    "Just below reporting threshold",
    "Young donor + very large amount",
    "Very large withdrawal",
]


def explanation_flags(a: Anchors) -> list[tuple[str, Column]]:
    amt = F.col("Donation_Amount")
    large = amt >= F.lit(a.amt_p75)
    return [
        (EXPLANATIONS[0], (F.col("Is_Night_Donation") == 1) & (F.col("Is_Transfer") == 1) & large),
        (EXPLANATIONS[1], (F.col("High_Risk_Platform") == 1) & large),
        (EXPLANATIONS[2], F.coalesce(F.col("Amt_LTV_Ratio") > F.lit(C.EXPLAIN_RATIO), F.lit(False))),
        (EXPLANATIONS[3], F.col("Low_Balance_Large_Gift") == 1),
        (EXPLANATIONS[4], (F.col("Is_Round_Amount") == 1) & large),
        (EXPLANATIONS[5], near_threshold(amt)),
        (EXPLANATIONS[6], F.col("Young_Large") == 1),
        (EXPLANATIONS[7], (F.col("Is_Withdrawal") == 1) & (amt >= F.lit(a.amt_mean + 2 * a.amt_std_pop))),
    ]


def explanations(a: Anchors) -> Column:
    """Array of explanation titles that fire for the row (T-c)."""
    arr = F.array(*[F.when(cond, F.lit(title)) for title, cond in explanation_flags(a)])
    return F.filter(arr, lambda x: x.isNotNull())


def score_and_tier(features: DataFrame, base_col: str = "Score_Norm") -> DataFrame:
    """T-d batch form: score = min(base + boost, 1), tier and action."""
    return (features.withColumn("Partner_Boost", partner_boost())
            .withColumn("Risk_Score", F.least(F.col(base_col) + F.col("Partner_Boost"), F.lit(1.0)))
            .withColumn("Risk_Tier", risk_tier(F.col("Risk_Score")))
            .withColumn("Recommended_Action", recommended_action(F.col("Risk_Tier"))))


def tier_breakdown(scored: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Count, percentage and anomaly rate per tier in fixed order; missing
    tiers appear with 0 (left join from the tier dimension)."""
    spark = spark or scored.sparkSession
    dim = spark.createDataFrame([(t, i) for i, t in enumerate(C.TIER_ORDER)], "Risk_Tier string, tier_rank int")
    counts = scored.groupBy("Risk_Tier").agg(F.count("*").alias("n"), F.avg("Is_Anomalous").alias("anomaly_rate"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    # the joined table has one row per tier, so the total is a window over 4 rows
    return (F.broadcast(dim).join(counts, "Risk_Tier", "left")
            .select("Risk_Tier", "tier_rank", n.alias("n"),
                    (n * 100.0 / F.sum(n).over(Window.partitionBy())).alias("pct"), "anomaly_rate"))


def triage_queue(scored: DataFrame, tiers: list[str] | None = None, n: int = 30,
                 score_col: str = "Risk_Score") -> DataFrame:
    """Tier filter -> score desc (Donation_ID breaks ties) -> top n. An empty
    selection means all tiers. Planned as TakeOrderedAndProject: each task keeps
    n rows, the driver merges n x tasks."""
    tiers = tiers or list(C.TIER_ORDER)
    return (scored.where(F.col("Risk_Tier").isin(tiers))
            .orderBy(F.col(score_col).desc(), F.col("Donation_ID")).limit(n))
