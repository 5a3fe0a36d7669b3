"""Core queries: reshape, anchors, features, rules, labels (S*, P*, G*, A5,
E*, R*, RL, A23, A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import rules as RU
from giftrisk.operators.features import amt_ltv_ratio
from giftrisk.plans.oracle import with_base
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.registry import q6, query, r6

P = Pipeline.get


# ---------------------------------------------------------------- reshape
_DON_SQL_COLS = ", ".join("CAST(Donation_Date AS VARCHAR) AS Donation_Date" if c == "Donation_Date" else c
                          for c in C.DONATION_COLUMNS)


@query("donations_reshaped", lambda: with_base(f"SELECT {_DON_SQL_COLS} FROM donations"))
def donations_reshaped(spark, sf_dir):
    """The 32-column donation table (date as ISO text for comparison)."""
    d = P(spark, sf_dir).donations()
    return d.select(*[F.date_format("Donation_Date", "yyyy-MM-dd").alias(c) if c == "Donation_Date" else F.col(c)
                      for c in C.DONATION_COLUMNS])


@query("currency_convert", lambda: with_base(
    "SELECT Donation_ID, Currency, Donation_Amount, Donor_Lifetime_Value FROM donations"))
def currency_convert(spark, sf_dir):
    return P(spark, sf_dir).donations().select(
        "Donation_ID", "Currency", "Donation_Amount", "Donor_Lifetime_Value")


@query("dimension_map_default", lambda: with_base(
    "SELECT Donor_Country, Donor_City, Donation_Platform, Payment_Processor, count(*) AS n "
    "FROM donations GROUP BY ALL"))
def dimension_map_default(spark, sf_dir):
    return (P(spark, sf_dir).donations()
            .groupBy("Donor_Country", "Donor_City", "Donation_Platform", "Payment_Processor")
            .agg(F.count("*").alias("n")))


@query("enrich_draws", lambda: with_base(
    "SELECT Donation_ID, Donor_Segment, Donation_Frequency, Donor_Since_Days, Is_Anonymous, "
    "Gift_Aid_Eligible, Refund_Requested, Is_Recurring, Matched_Giving, CVV_Check, Device_Fingerprint, "
    "Webhook_Event, IP_Country_Match, Is_VPN_Or_Proxy, IP_Velocity_24h FROM donations"))
def enrich_draws(spark, sf_dir):
    return P(spark, sf_dir).donations().select(
        "Donation_ID", "Donor_Segment", "Donation_Frequency", "Donor_Since_Days", "Is_Anonymous",
        "Gift_Aid_Eligible", "Refund_Requested", "Is_Recurring", "Matched_Giving", "CVV_Check",
        "Device_Fingerprint", "Webhook_Event", "IP_Country_Match", "Is_VPN_Or_Proxy", "IP_Velocity_24h")


@query("weighted_draw_share", lambda: with_base(
    "SELECT 'campaign' AS attribute, Campaign_ID AS value, count(*) AS n FROM donations GROUP BY ALL "
    "UNION ALL SELECT 'frequency', Donation_Frequency, count(*) FROM donations GROUP BY ALL "
    "UNION ALL SELECT 'channel', Acquisition_Channel, count(*) FROM donations GROUP BY ALL"))
def weighted_draw_share(spark, sf_dir):
    """G1 check: realised counts of the three weighted categorical draws."""
    d = P(spark, sf_dir).donations()
    # one scan: stack the three attributes, then group
    pairs = [("campaign", "Campaign_ID"), ("frequency", "Donation_Frequency"), ("channel", "Acquisition_Channel")]
    long = d.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(c).alias("value")) for a, c in pairs])))
    return long.groupBy("attribute", "value").agg(F.count("*").alias("n"))


# rate per INR as an integer number of 1e-4 units
_RATE_INT = {k: round(float(v) * 10000) for k, v in C.RATE_BY_CURRENCY.items()}


def _gbp_sql():
    r = "(CASE Currency " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RATE_INT.items()) + " END)"
    cents = "CAST(round(Donation_Amount * 100) AS BIGINT)"
    return with_base(
        f"SELECT Donation_ID, Currency, CAST(floor((2 * {cents} * {_RATE_INT['GBP']} + {r}) / (2 * {r})) AS BIGINT)"
        " / 100.0 AS Amount_GBP FROM donations")


@query("amount_normalised", _gbp_sql)
def amount_normalised(spark, sf_dir):
    """Amount in one currency (GBP), exact half-up integer-cent arithmetic."""
    d = P(spark, sf_dir).donations()
    rates = F.create_map(*[x for k, v in _RATE_INT.items() for x in (F.lit(k), F.lit(v))])
    r = rates[F.col("Currency")]
    cents = F.round(F.col("Donation_Amount") * 100).cast("bigint")
    gbp = F.floor((2 * cents * _RATE_INT["GBP"] + r) / (2 * r)).cast("bigint") / 100.0
    return d.select("Donation_ID", "Currency", gbp.alias("Amount_GBP"))


# ---------------------------------------------------------------- anchors
_ANCHOR_COLS = ["amt_mean", "amt_std_pop", "amt_std_samp", "amt_p75", "amt_p90", "amt_p95",
                "ltv_p10", "ratio_p90"]


@query("anchors", lambda: with_base(
    "SELECT n, " + ", ".join(f"{q6(c)} AS {c}" for c in _ANCHOR_COLS) + " FROM anchors"))
def anchors(spark, sf_dir):
    a = P(spark, sf_dir).anchors()
    d = P(spark, sf_dir).donations()
    # returned as a one-row DataFrame derived from the table (scalars are exact)
    return d.agg(F.count("*").alias("n")).select(
        "n", *[r6(F.lit(getattr(a, c))).alias(c) for c in _ANCHOR_COLS])


@query("anchors_by_currency", lambda: with_base(
    "SELECT Currency, count(*) AS n, " + q6("avg(Donation_Amount)") + " AS amt_mean, "
    + q6("quantile_cont(Donation_Amount, 0.75)") + " AS amt_p75, "
    + q6("quantile_cont(Donation_Amount, 0.90)") + " AS amt_p90, "
    + q6("quantile_cont(Donor_Lifetime_Value, 0.10)") + " AS ltv_p10 FROM donations GROUP BY Currency"))
def anchors_by_currency(spark, sf_dir):
    """D10 option: anchors per currency group (exact grouped percentile)."""
    from giftrisk.operators.aggregates import _label_lit, group_quantiles
    d = P(spark, sf_dir).donations()
    amt = F.col("Donation_Amount")
    cur = [r[0] for r in d.select("Currency").distinct().collect()]  # a handful of currencies
    qa = group_quantiles(d, "Donation_Amount", {"amt_p75": 0.75, "amt_p90": 0.90}, "Currency", cur)
    ql = group_quantiles(d, "Donor_Lifetime_Value", {"ltv_p10": 0.10}, "Currency", cur)
    col = lambda q, name: _label_lit("Currency", {c: q[(c, name)] for c in cur})
    return d.groupBy("Currency").agg(
        F.count("*").alias("n"), r6(F.avg(amt)).alias("amt_mean"),
        r6(F.first(col(qa, "amt_p75"))).alias("amt_p75"), r6(F.first(col(qa, "amt_p90"))).alias("amt_p90"),
        r6(F.first(col(ql, "ltv_p10"))).alias("ltv_p10"))


# ---------------------------------------------------------------- features
_FLOAT_FEATURES = {"Log_Donor_Lifetime_Value", "Log_Donation_Amount", "Donation_Amount_Zscore",
                   "Amt_LTV_Ratio"}


def _feature_sql():
    cols = []
    for c in C.NUMERIC_FEATURES:
        cols.append(f"{q6(c)} AS {c}" if c in _FLOAT_FEATURES else c)
    return with_base("SELECT Donation_ID, " + ", ".join(cols) + " FROM features")


@query("features_numeric", _feature_sql)
def features_numeric(spark, sf_dir):
    f = P(spark, sf_dir).features()
    return f.select("Donation_ID", *[r6(c).alias(c) if c in _FLOAT_FEATURES else F.col(c)
                                     for c in C.NUMERIC_FEATURES])


@query("feature_zscore", lambda: with_base(
    f"SELECT Donation_ID, {q6('Donation_Amount_Zscore')} AS z_pop, "
    f"{q6('(Donation_Amount - a.amt_mean) / a.amt_std_samp')} AS z_samp FROM features, anchors a"))
def feature_zscore(spark, sf_dir):
    """Global z-score (population std, plus the sample-std variant)."""
    p = P(spark, sf_dir)
    a = p.anchors()
    return p.features().select(
        "Donation_ID", r6("Donation_Amount_Zscore").alias("z_pop"),
        r6((F.col("Donation_Amount") - F.lit(a.amt_mean)) / F.lit(a.amt_std_samp)).alias("z_samp"))


@query("near_threshold", lambda: with_base(
    "SELECT Donation_ID, Donation_Amount, Near_Threshold, Is_Round_Amount FROM features "
    "WHERE Near_Threshold = 1 OR Is_Round_Amount = 1"))
def near_threshold_q(spark, sf_dir):
    return (P(spark, sf_dir).features()
            .where((F.col("Near_Threshold") == 1) | (F.col("Is_Round_Amount") == 1))
            .select("Donation_ID", "Donation_Amount", "Near_Threshold", "Is_Round_Amount"))


@query("scorer_flags", lambda: with_base(
    "SELECT Donation_ID, Low_Balance_Large_Gift, Young_Large, Is_Withdrawal, Is_Transfer, "
    "Is_Corporate_Night, Is_First_Time_Large FROM features"))
def scorer_flags(spark, sf_dir):
    """Flags the single-donation scorer reads but training never made."""
    return P(spark, sf_dir).features().select(
        "Donation_ID", "Low_Balance_Large_Gift", "Young_Large", "Is_Withdrawal", "Is_Transfer",
        "Is_Corporate_Night", "Is_First_Time_Large")


# ---------------------------------------------------------------- rules
_RULE_COLS = ["Flag_Count"] + [f"{r}_10" for r in RU.RULE_IDS] + ["Rule_Score_10"]


@query("rule_scores", lambda: with_base(
    "SELECT Donation_ID, " + ", ".join(_RULE_COLS) + ", Rule_Score FROM scored"))
def rule_scores(spark, sf_dir):
    return P(spark, sf_dir).labeled().select("Donation_ID", *_RULE_COLS, "Rule_Score")


@query("flag_count", lambda: with_base(
    "SELECT Flag_Count, count(*) AS n FROM scored GROUP BY Flag_Count"))
def flag_count(spark, sf_dir):
    return P(spark, sf_dir).labeled().groupBy("Flag_Count").agg(F.count("*").alias("n"))


@query("rules_fired_long", lambda: with_base(
    "SELECT Donation_ID, unnest(Fired_Terms) AS term FROM scored"))
def rules_fired_long(spark, sf_dir):
    return P(spark, sf_dir).labeled().select("Donation_ID", F.explode("Fired_Terms").alias("term"))


@query("rule_term_counts", lambda: with_base(
    "SELECT term, count(*) AS n FROM (SELECT unnest(Fired_Terms) AS term FROM scored) GROUP BY term"))
def rule_term_counts(spark, sf_dir):
    return (P(spark, sf_dir).labeled().select(F.explode("Fired_Terms").alias("term"))
            .groupBy("term").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- labels
@query("rule_labels", lambda: with_base(
    "SELECT Donation_ID, " + q6("Score_Norm", 9) + " AS Score_Norm, " + q6("Score_Noisy", 9)
    + " AS Score_Noisy, Label_Raw, Label_Flipped, Is_Anomalous FROM labeled"))
def rule_labels(spark, sf_dir):
    return P(spark, sf_dir).labeled().select(
        "Donation_ID", r6("Score_Norm", 9).alias("Score_Norm"), r6("Score_Noisy", 9).alias("Score_Noisy"),
        "Label_Raw", "Label_Flipped", "Is_Anomalous")


@query("label_noise_flips", lambda: with_base(
    "SELECT count_if(Label_Raw = 1) AS n_raw_pos, count_if(Label_Raw = 1 AND Label_Flipped = 1) AS n_missed, "
    "count_if(Label_Raw = 0 AND Label_Flipped = 1) AS n_false_flag, count_if(Is_Anomalous = 1) AS n_pos, "
    "count(*) AS n FROM labeled"))
def label_noise_flips(spark, sf_dir):
    lab, flip = F.col("Label_Raw"), F.col("Label_Flipped")
    return P(spark, sf_dir).labeled().agg(
        F.count_if(lab == 1).alias("n_raw_pos"), F.count_if((lab == 1) & (flip == 1)).alias("n_missed"),
        F.count_if((lab == 0) & (flip == 1)).alias("n_false_flag"),
        F.count_if(F.col("Is_Anomalous") == 1).alias("n_pos"), F.count("*").alias("n"))


def _lift_sql():
    from giftrisk.plans.oracle import FLAG_SQL, inlist, near_sql
    L = "Donation_Amount >= a.amt_p75"
    masks = [
        ("Refund requested", "Refund_Requested = 1"),
        ("Refund + large amount", f"Refund_Requested = 1 AND {L}"),
        ("Anonymous + large", f"Is_Anonymous = 1 AND {L}"),
        ("First-time + ≥p90 amount", "Donation_Frequency = 'First-time' AND Donation_Amount >= a.amt_p90"),
        ("CVV fail", "CVV_Check = 'Fail'"),
        ("Known flagged device", "Device_Fingerprint = 'Known Flagged'"),
        ("Chargeback webhook", "Webhook_Event = 'chargeback.received'"),
        ("Payment reversed webhook", "Webhook_Event = 'payment.reversed'"),
        ("High-risk platform + large", f"{FLAG_SQL[5]} AND {L}"),
        ("Donation >> lifetime value (p90)", "coalesce(Amt_LTV_Ratio > a.ratio_p90, false)"),
        ("Night + transfer + large", f"{FLAG_SQL[6]} AND Donation_Type = 'Bank Transfer' AND {L}"),
        ("Large round number", "Donation_Amount % 50 = 0 AND Donation_Amount >= a.amt_p90"),
        ("Cold outreach + large + first-time",
         f"Acquisition_Channel = 'Cold Outreach' AND {L} AND Donation_Frequency = 'First-time'"),
        ("Corporate + night + transfer",
         f"Donor_Segment = 'Corporate' AND {FLAG_SQL[6]} AND Donation_Type = 'Bank Transfer'"),
        ("Matched giving + anonymous", "Matched_Giving = 1 AND Is_Anonymous = 1"),
        ("Near-threshold structuring", near_sql()),
        ("3+ flags triggered", "Flag_Count >= 3"),
        ("IP country mismatch", "IP_Country_Match = 0"),
        ("IP mismatch + large", f"IP_Country_Match = 0 AND {L}"),
        ("VPN or proxy", "Is_VPN_Or_Proxy = 1"),
        ("VPN + anonymous", "Is_VPN_Or_Proxy = 1 AND Is_Anonymous = 1"),
        ("VPN + CVV fail", "Is_VPN_Or_Proxy = 1 AND CVV_Check = 'Fail'"),
        ("IP velocity >= 3 (card testing)", "IP_Velocity_24h >= 3"),
        ("IP velocity >= 5 (bot/attack)", "IP_Velocity_24h >= 5"),
        ("Baseline (all)", "true"),
    ]
    del inlist
    parts = []
    for i, (name, m) in enumerate(masks):
        nm = name.replace("'", "''")
        parts.append(f"SELECT {i} AS ord, '{nm}' AS check_name, count_if({m}) AS n, "
                     f"avg(CASE WHEN {m} THEN Is_Anomalous END) AS rate FROM labeled, anchors a")
    return with_base(
        "SELECT ord, check_name, n, " + q6("rate") + " AS rate, " + q6("rate / base") + " AS lift FROM ("
        + " UNION ALL ".join(parts) + "), (SELECT avg(Is_Anomalous) AS base FROM labeled) WHERE n > 0")


@query("rule_lift", _lift_sql)
def rule_lift(spark, sf_dir):
    """N, anomaly rate and lift for the 25 validation masks, one scan."""
    p = P(spark, sf_dir)
    lab = p.labeled().withColumn("_ratio", amt_ltv_ratio(F.col("Donation_Amount"), F.col("Donor_Lifetime_Value")))
    lab = lab.withColumn("_hour", F.col("Hour"))
    c = RU.Ctx(p.anchors())
    masks = RU.validation_masks(c)
    y = F.col("Is_Anomalous")
    aggs = [F.avg(y).alias("base")]
    for i, (_, m) in enumerate(masks):
        aggs += [F.count_if(m).alias(f"n{i}"), F.avg(F.when(m, y)).alias(f"r{i}")]
    wide = lab.agg(*aggs)
    stack = F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("check_name"),
                                         F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rate"))
                               for i, (name, _) in enumerate(masks)]))
    return (wide.select("base", stack).where(F.col("n") > 0)
            .select("ord", "check_name", "n", r6("rate").alias("rate"),
                    r6(F.col("rate") / F.col("base")).alias("lift")))
