"""Exploratory aggregates and dashboard reports as DataFrames (A1-A31,
K1-K11, L2-L9, W1, J1, J12, J13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import aggregates as AG
from giftrisk.plans.oracle import D
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.q_triage import risk, with_risk, wr
from giftrisk.plans.registry import q6, query, r6

P = Pipeline.get
Y = "Is_Anomalous"
CATEGORIES = ["Campaign_ID", "Donation_Platform", "Payment_Processor", "Acquisition_Channel",
              "Donor_Segment", "Donation_Type"]


def lab(spark, sf_dir):
    return P(spark, sf_dir).labeled()


@query("rate_by_hour", wr("SELECT Hour, count(*) AS n, " + q6("avg(Is_Anomalous)") + " AS rate FROM riskq GROUP BY Hour"))
def rate_by_hour(spark, sf_dir):
    """A1 / K4."""
    return lab(spark, sf_dir).groupBy("Hour").agg(F.count("*").alias("n"), r6(F.avg(Y)).alias("rate"))


@query("rate_by_weekday", wr(
    "SELECT w.ord, w.day, coalesce(g.n, 0) AS n, " + q6("g.rate") + " AS rate FROM (VALUES "
    + ", ".join(f"({i}, '{d}')" for i, d in enumerate(C.WEEKDAYS)) + ") w(ord, day) LEFT JOIN "
    "(SELECT DayOfWeek, count(*) AS n, avg(Is_Anomalous) AS rate FROM riskq GROUP BY DayOfWeek) g "
    "ON w.day = g.DayOfWeek"))
def rate_by_weekday(spark, sf_dir):
    """A1 + L5: fixed Monday..Sunday order via the weekday dimension."""
    g = lab(spark, sf_dir).groupBy("DayOfWeek").agg(F.count("*").alias("n"), F.avg(Y).alias("rate"))
    return AG.ordered_dimension(spark, "day", C.WEEKDAYS).join(
        g, F.col("day") == F.col("DayOfWeek"), "left").select(
        "ord", "day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), r6("rate").alias("rate"))


@query("rate_by_country_top20", wr(
    "SELECT Donor_Country, n, " + q6("rate") + " AS rate, CAST(rate > base AS INTEGER) AS above_baseline FROM ("
    "SELECT Donor_Country, count(*) AS n, avg(Is_Anomalous) AS rate FROM riskq GROUP BY Donor_Country), "
    "(SELECT avg(Is_Anomalous) AS base FROM riskq) ORDER BY rate DESC, Donor_Country LIMIT 20"))
def rate_by_country_top20(spark, sf_dir):
    """A2 + L2 / K5: rate and count per country, top 20 by rate."""
    d = lab(spark, sf_dir)
    base = d.agg(F.avg(Y)).first()[0]
    g = d.groupBy("Donor_Country").agg(F.count("*").alias("n"), F.avg(Y).alias("rate"))
    return (g.orderBy(F.col("rate").desc(), "Donor_Country").limit(20)
            .select("Donor_Country", "n", r6("rate").alias("rate"),
                    (F.col("rate") > F.lit(base)).cast("int").alias("above_baseline")))


def _sets_sql():
    parts = [f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, avg(Is_Anomalous) AS rate "
             f"FROM riskq GROUP BY {c}" for c in CATEGORIES]
    return "SELECT dimension, value, n, " + q6("rate") + " AS rate FROM (" + " UNION ALL ".join(parts) + ")"


@query("rate_by_category_sets", wr(_sets_sql()))
def rate_by_category_sets(spark, sf_dir):
    """K6 / A1: six category rate tables from one scan (GROUPING SETS)."""
    g = AG.rate_by_dimensions(lab(spark, sf_dir), CATEGORIES, Y)
    return g.select("dimension", "value", "n", r6("rate").alias("rate"))


@query("peak_groups", wr(
    "SELECT dimension, value, " + q6("rate") + " AS rate FROM (SELECT *, row_number() OVER (PARTITION BY dimension "
    "ORDER BY rate DESC, value) AS rn FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, avg(Is_Anomalous) AS rate FROM riskq GROUP BY {c}"
        for c in ["Hour", "DayOfWeek", "Donor_Country", "Campaign_ID"]) + ")) WHERE rn = 1"))
def peak_groups(spark, sf_dir):
    """Arg-max group (peak hour / weekday / country / campaign), ties to
    the smallest key."""
    g = AG.rate_by_dimensions(lab(spark, sf_dir), ["Hour", "DayOfWeek", "Donor_Country", "Campaign_ID"], Y)
    return AG.argmax_per_dimension(g).select("dimension", "value", r6("rate").alias("rate"))


@query("value_counts_share", wr(
    "SELECT Donation_Platform, n, " + q6("n * 1.0 / sum(n) OVER ()") + " AS share FROM "
    "(SELECT Donation_Platform, count(*) AS n FROM riskq GROUP BY Donation_Platform)"))
def value_counts_share(spark, sf_dir):
    """Value counts and share (window over the small grouped table)."""
    g = lab(spark, sf_dir).groupBy("Donation_Platform").agg(F.count("*").alias("n"))
    return g.select("Donation_Platform", "n", r6(F.col("n") * 1.0 / F.sum("n").over(Window.partitionBy()))
                    .alias("share"))


_PROFILE = ["Donation_Amount", "Donor_Lifetime_Value", "Age", "Donor_Since_Days", "IP_Velocity_24h"]


@query("numeric_profile", wr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, {q6(f'avg({c})')} AS mean, {q6(f'stddev_samp({c})')} AS std, "
    f"{q6(f'min({c})')} AS min, {q6(f'quantile_cont({c}, 0.25)')} AS p25, {q6(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{q6(f'quantile_cont({c}, 0.75)')} AS p75, {q6(f'max({c})')} AS max FROM riskq" for c in _PROFILE)))
def numeric_profile(spark, sf_dir):
    """A13 (describe): count, mean, std, min, quartiles, max per column."""
    return AG.numeric_profile(lab(spark, sf_dir), _PROFILE).select(
        "column_name", "n", *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


_MIXED = ["Donor_Country", "Donor_Segment", "Donation_Type", "Donation_Platform", "CVV_Check", "Webhook_Event"]


@query("mixed_profile", wr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM riskq) AS n, (SELECT count(DISTINCT {c}) FROM riskq) AS n_unique, "
    f"value AS top, freq FROM (SELECT {c} AS value, count(*) AS freq FROM riskq WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY freq DESC, value LIMIT 1)" for c in _MIXED)))
def mixed_profile(spark, sf_dir):
    """Count, unique, top and freq per categorical column."""
    return AG.categorical_profile(lab(spark, sf_dir), _MIXED)


@query("null_counts", wr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM riskq HAVING count(*) - count({c}) > 0"
    for c in ["Hour", "Amt_LTV_Ratio", "Donor_Segment", "Donation_Type", "Donation_Date"])))
def null_counts(spark, sf_dir):
    """Missing values per column, only columns with any (the donations have
    none; ``null_counts_reviewed`` looks at columns that do)."""
    return AG.null_counts(lab(spark, sf_dir), ["Hour", "Amt_LTV_Ratio", "Donor_Segment", "Donation_Type",
                                               "Donation_Date"])


_CORR = [c for c in C.NUMERIC_FEATURES]


@query("corr_with_label", wr(
    "SELECT feature, " + q6("r") + " AS corr FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, Is_Anomalous) AS r FROM riskq" for c in _CORR)
    + ") WHERE r IS NOT NULL AND NOT isnan(r)"))
def corr_with_label(spark, sf_dir):
    """Pearson correlation of every numeric feature with the label."""
    c = AG.correlations(lab(spark, sf_dir), _CORR, Y)
    return c.select("feature", r6("corr").alias("corr"))


@query("amount_histogram", wr(
    "SELECT Is_Anomalous, bin, count(*) AS n, " + q6("count(*) / (max(cnt) * max(w))") + " AS density FROM ("
    "SELECT Is_Anomalous, least(CAST(floor((Donation_Amount - mn) * 70 / (mx - mn)) AS INTEGER), 69) AS bin, "
    "cnt, (mx - mn) / 70 AS w FROM riskq JOIN (SELECT Is_Anomalous AS y, min(Donation_Amount) AS mn, "
    "max(Donation_Amount) AS mx, count(*) AS cnt FROM riskq GROUP BY Is_Anomalous) s ON Is_Anomalous = s.y) "
    "GROUP BY Is_Anomalous, bin"))
def amount_histogram(spark, sf_dir):
    """70 equal-width bins per label over that label's own range,
    with density n / (N * width)."""
    h = AG.histogram(lab(spark, sf_dir), "Donation_Amount", Y, 70)
    return h.select(Y, "bin", "n", r6("density").alias("density"))


@query("amount_boxstats", wr(
    ", st AS (SELECT Is_Anomalous AS y, quantile_cont(Donation_Amount, 0.25) AS q1, "
    "quantile_cont(Donation_Amount, 0.5) AS med, quantile_cont(Donation_Amount, 0.75) AS q3 FROM riskq "
    "GROUP BY Is_Anomalous) SELECT y AS Is_Anomalous, " + q6("q1") + " AS q1, " + q6("med") + " AS median, "
    + q6("q3") + " AS q3, " + q6("min(Donation_Amount) FILTER (WHERE Donation_Amount >= q1 - 1.5 * (q3 - q1))")
    + " AS whisker_lo, " + q6("max(Donation_Amount) FILTER (WHERE Donation_Amount <= q3 + 1.5 * (q3 - q1))")
    + " AS whisker_hi, count_if(Donation_Amount < q1 - 1.5 * (q3 - q1) OR Donation_Amount > q3 + 1.5 * (q3 - q1)) "
    "AS n_outliers FROM riskq JOIN st ON Is_Anomalous = y GROUP BY y, q1, med, q3"))
def amount_boxstats(spark, sf_dir):
    """Quartiles, whiskers (extremes within 1.5 IQR) and outlier count per label."""
    b = AG.box_stats(lab(spark, sf_dir), "Donation_Amount", Y)
    return b.select(Y, *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]], "n_outliers")


@query("median_ratio", wr(
    "SELECT " + q6("quantile_cont(Donation_Amount, 0.5) FILTER (WHERE Is_Anomalous = 1)") + " AS median_anomalous, "
    + q6("quantile_cont(Donation_Amount, 0.5) FILTER (WHERE Is_Anomalous = 0)") + " AS median_legit, "
    + q6("quantile_cont(Donation_Amount, 0.5) FILTER (WHERE Is_Anomalous = 1) / "
         "quantile_cont(Donation_Amount, 0.5) FILTER (WHERE Is_Anomalous = 0)") + " AS ratio FROM riskq"))
def median_ratio(spark, sf_dir):
    """Median amount by label and their ratio."""
    m = AG.medians_by_label(lab(spark, sf_dir), "Donation_Amount", Y)
    return m.select(r6("median_anomalous").alias("median_anomalous"), r6("median_legit").alias("median_legit"),
                    r6(F.col("median_anomalous") / F.col("median_legit")).alias("ratio"))


def _kpi_cols(prefix=""):
    return [
        ("total", "count(*)"), ("n_anomalous", "CAST(sum(Is_Anomalous) AS BIGINT)"),
        ("anomaly_rate", q6("avg(Is_Anomalous)")),
        ("amount_mean", q6("avg(Donation_Amount)")), ("amount_std", q6("stddev_samp(Donation_Amount)")),
        ("night_rate", q6("avg(CASE WHEN Is_Night_Donation = 1 THEN Is_Anomalous END)")),
        ("high_risk_n", "CAST(sum(CASE WHEN High_Risk_Platform = 1 THEN Is_Anomalous ELSE 0 END) AS BIGINT)"),
        ("refund_rate", q6("avg(Refund_Requested)")), ("anon_rate", q6("avg(Is_Anonymous)")),
        ("ip_mismatch_rate", q6("avg(CASE WHEN IP_Country_Match = 0 THEN 1.0 ELSE 0.0 END)")),
        ("vpn_rate", q6("avg(Is_VPN_Or_Proxy)")),
        ("high_velocity_rate", q6("avg(CASE WHEN IP_Velocity_24h >= 3 THEN 1.0 ELSE 0.0 END)")),
    ]


@query("kpis", wr("SELECT " + ", ".join(f"{e} AS {n}" for n, e in _kpi_cols()) + " FROM riskq"))
def kpis(spark, sf_dir):
    """KPI bar and meta rates in one aggregate."""
    return AG.kpis(lab(spark, sf_dir))


@query("donor_aggregates", wr(
    "SELECT Donor_ID, count(*) AS n_donations, " + q6("avg(Donation_Amount)") + " AS mean_amount, "
    + q6("coalesce(stddev_samp(Donation_Amount), 0)") + " AS std_amount, max(Donation_Amount) AS max_amount, "
    "count(DISTINCT Campaign_ID) AS n_campaigns, count(DISTINCT Donation_Platform) AS n_platforms "
    "FROM riskq GROUP BY Donor_ID"))
def donor_aggregates(spark, sf_dir):
    """A4: donor-level aggregates (partial aggregation map side)."""
    a = AG.donor_aggregates(lab(spark, sf_dir))
    return a.select("Donor_ID", "n_donations", r6("mean_amount").alias("mean_amount"),
                    r6("std_amount").alias("std_amount"), "max_amount", "n_campaigns", "n_platforms")


@query("donor_deviation", wr(
    "SELECT Donation_ID, Donor_ID, " + q6("(Donation_Amount - mean_amount) / (std_amount + 1)") + " AS deviation, "
    + q6("Donation_Amount / sum_amount") + " AS amount_to_cumulative FROM riskq JOIN (SELECT Donor_ID AS d, "
    "avg(Donation_Amount) AS mean_amount, coalesce(stddev_samp(Donation_Amount), 0) AS std_amount, "
    "sum(Donation_Amount) AS sum_amount FROM riskq GROUP BY Donor_ID) ON Donor_ID = d"))
def donor_deviation(spark, sf_dir):
    """Deviation from the donor's own mean, by aggregate-then-join
    (skew-tolerant; AQE splits a hot donor's partition on the join)."""
    d = AG.donor_deviation(lab(spark, sf_dir))
    return d.select("Donation_ID", "Donor_ID", r6("deviation").alias("deviation"),
                    r6("amount_to_cumulative").alias("amount_to_cumulative"))


@query("bias_audit", wr(
    "SELECT grp, value, count(*) AS n, " + q6("avg(CAST(flag AS DOUBLE))") + " AS flag_rate, "
    + q6("coalesce(sum(CASE WHEN flag THEN Is_Anomalous ELSE 0 END) * 1.0 / nullif(count_if(flag), 0), 0)")
    + " AS precision, " + q6("coalesce(count_if(flag AND Is_Anomalous = 0) * 1.0 / nullif(count_if(Is_Anomalous = 0), 0), 0)")
    + " AS fpr FROM (SELECT *, Risk_Tier IN ('Critical', 'High') AS flag FROM riskq), LATERAL (VALUES "
    "('gender', Gender), ('age_band', CASE WHEN Age < 25 THEN '18-24' WHEN Age < 40 THEN '25-39' "
    "WHEN Age < 60 THEN '40-59' ELSE '60+' END), ('country', Donor_Country)) t(grp, value) GROUP BY grp, value"))
def bias_audit(spark, sf_dir):
    """Flag rate, precision and false-positive rate by gender, age band
    and country (flag = Critical or High tier)."""
    b = AG.bias_audit(risk(spark, sf_dir))
    return b.select("grp", "value", "n", r6("flag_rate").alias("flag_rate"), r6("precision").alias("precision"),
                    r6("fpr").alias("fpr"))


@query("label_signal_diagnostics", wr(
    "SELECT 'country' AS dimension, " + q6("min(rate)") + " AS min_rate, " + q6("max(rate)") + " AS max_rate, "
    + q6("stddev_pop(rate)") + " AS sd_rate FROM (SELECT Donor_Country, avg(Is_Anomalous) AS rate FROM riskq GROUP BY 1) "
    "UNION ALL SELECT 'campaign', " + q6("min(rate)") + ", " + q6("max(rate)") + ", " + q6("stddev_pop(rate)")
    + " FROM (SELECT Campaign_ID, avg(Is_Anomalous) AS rate FROM riskq GROUP BY 1) "
    "UNION ALL SELECT 'top_1pct_amount', " + q6("min(rate)") + ", " + q6("max(rate)") + ", " + q6("stddev_pop(rate)")
    + " FROM (SELECT unnest([avg(Is_Anomalous), avg(CASE WHEN Donation_Amount >= (SELECT quantile_cont(Donation_Amount, 0.99) FROM riskq) "
    "THEN Is_Anomalous END)]) AS rate FROM riskq)"))
def label_signal_diagnostics(spark, sf_dir):
    """Spread of group anomaly rates (min / max / population sd); the last row is
    the rate of all rows against that of the top 1 % of amounts."""
    df = lab(spark, sf_dir)
    two = AG.top_amount_rate(df, "Donation_Amount", Y)
    low, high = F.least("base_rate", "top_rate"), F.greatest("base_rate", "top_rate")
    return AG.rate_spread(df, {"country": "Donor_Country", "campaign": "Campaign_ID"}, Y).unionByName(two.select(
        F.lit("top_1pct_amount").alias("dimension"), r6(low).alias("min_rate"), r6(high).alias("max_rate"), r6((high - low) / 2).alias("sd_rate")))


@query("top_amount_rate", wr(
    "SELECT " + q6("cut") + " AS cut, count_if(Donation_Amount >= cut) AS n_top, "
    + q6("avg(CASE WHEN Donation_Amount >= cut THEN Is_Anomalous END)") + " AS top_rate, " + q6("avg(Is_Anomalous)") + " AS base_rate "
    "FROM riskq, (SELECT quantile_cont(Donation_Amount, 0.99) AS cut FROM riskq) GROUP BY cut"))
def top_amount_rate(spark, sf_dir):
    """Anomaly rate in the top 1 % of amounts beside the baseline."""
    t = AG.top_amount_rate(lab(spark, sf_dir), "Donation_Amount", Y)
    return t.select(r6("cut").alias("cut"), "n_top", r6("top_rate").alias("top_rate"), r6("base_rate").alias("base_rate"))


@query("review_feedback", wr(
    "SELECT Donation_ID, Is_Anomalous, CASE WHEN Risk_Tier IN ('Critical', 'High') THEN CAST(Label_Raw AS DOUBLE) END AS Reviewed_Label, "
    "CASE WHEN Risk_Tier IN ('Critical', 'High') THEN Label_Raw ELSE Is_Anomalous END AS Final_Label FROM riskq"))
def review_feedback(spark, sf_dir):
    """Reviewed outcome overrides the generated label. The review table is
    the Critical/High queue with the noise-free rule label as the reviewer's
    finding; left join + coalesce, every donation comes back."""
    r = risk(spark, sf_dir)
    reviews = r.where(F.col("Risk_Tier").isin("Critical", "High")).select(
        "Donation_ID", F.col("Label_Raw").cast("double").alias("Reviewed_Label"))
    j = r.select("Donation_ID", Y).join(reviews, "Donation_ID", "left")
    return j.withColumn("Final_Label", F.coalesce(F.col("Reviewed_Label").cast("int"), Y))


_REVIEWED = ("(SELECT Donation_ID, Donor_Segment, CASE WHEN Risk_Tier IN ('Critical', 'High') THEN Label_Raw END AS Reviewed_Label, "
             "CASE WHEN Risk_Tier IN ('Critical', 'High') THEN Risk_Tier END AS Review_Queue FROM riskq)")


@query("null_counts_reviewed", wr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM {_REVIEWED} HAVING count(*) - count({c}) > 0"
    for c in ["Donation_ID", "Donor_Segment", "Reviewed_Label", "Review_Queue"])))
def null_counts_reviewed(spark, sf_dir):
    """A17 over the donations with their review, where most have none."""
    r = risk(spark, sf_dir)
    seen = F.col("Risk_Tier").isin("Critical", "High")
    return AG.null_counts(r.select("Donation_ID", "Donor_Segment", F.when(seen, F.col("Label_Raw")).alias("Reviewed_Label"),
                                   F.when(seen, F.col("Risk_Tier")).alias("Review_Queue")),
                          ["Donation_ID", "Donor_Segment", "Reviewed_Label", "Review_Queue"])


@query("restricted_country", wr(
    "SELECT Donation_ID, Donor_Country FROM riskq WHERE Donor_Country IN (SELECT Donor_Country FROM riskq "
    "GROUP BY Donor_Country HAVING avg(Is_Anomalous) > " + D(1.5) + " * (SELECT avg(Is_Anomalous) FROM riskq))"))
def restricted_country(spark, sf_dir):
    """Donations from high-rate countries (rate > 1.5 x baseline), a
    left-semi join against the small per-country table."""
    d = lab(spark, sf_dir)
    base = d.agg(F.avg(Y)).first()[0]
    hot = d.groupBy("Donor_Country").agg(F.avg(Y).alias("rate")).where(F.col("rate") > F.lit(1.5 * base))
    return d.join(F.broadcast(hot.select("Donor_Country")), "Donor_Country", "left_semi").select(
        "Donation_ID", "Donor_Country")


@query("seeded_sample", wr(
    "SELECT Donation_ID FROM riskq ORDER BY md5(Donation_ID || '|sample'), Donation_ID LIMIT 200"))
def seeded_sample(spark, sf_dir):
    """Deterministic sample of 200 rows (order by a key hash; TakeOrdered)."""
    d = lab(spark, sf_dir)
    return (d.select("Donation_ID").orderBy(F.md5(F.concat(F.col("Donation_ID"), F.lit("|sample"))), "Donation_ID")
            .limit(200))


@query("preview_rows", wr("SELECT Donation_ID, Donor_ID, Donation_Amount FROM riskq ORDER BY "
                          "CAST(Donation_ID AS BIGINT) LIMIT 5"))
def preview_rows(spark, sf_dir):
    """First rows preview in key order."""
    return (lab(spark, sf_dir).select("Donation_ID", "Donor_ID", "Donation_Amount")
            .orderBy(F.col("Donation_ID").cast("bigint")).limit(5))


@query("meta_rates", lambda: with_risk(
    ", k AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _kpi_cols()) + " FROM riskq) SELECT k.*, "
    + ", ".join(f"{q6('a.' + c)} AS {c}" for c in ["amt_p75", "amt_p90", "ltv_p10"]) + " FROM k, anchors a"))
def meta_rates(spark, sf_dir):
    """The meta table — KPIs and rates together with the amount / LTV
    anchors used by the rules."""
    a = P(spark, sf_dir).anchors()
    return AG.kpis(lab(spark, sf_dir)).select(
        "*", *[r6(F.lit(getattr(a, c))).alias(c) for c in ["amt_p75", "amt_p90", "ltv_p10"]])
