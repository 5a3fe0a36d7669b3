"""Scoring, triage and evaluation queries (T-a..T-g, L1, V1-V10, A25, K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import evaluate as EV
from giftrisk.operators import triage as TR
from giftrisk.plans.oracle import D, inlist, near_sql, with_base
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.registry import q6, query, r6

P = Pipeline.get


def risk(spark, sf_dir):
    p = P(spark, sf_dir)
    lab = p.labeled()
    return TR.score_and_tier(lab).withColumn("Explanations", TR.explanations(p.anchors()))


def _boost_sql():
    dev = " ".join(f"WHEN {k!r} THEN {D(v)}" for k, v in C.BOOST_DEVICE.items())
    hook = " ".join(f"WHEN {k!r} THEN {D(v)}" for k, v in C.BOOST_WEBHOOK.items())
    return (f"(CASE WHEN CVV_Check = 'Fail' THEN {D(C.BOOST_CVV_FAIL)} ELSE {D(0)} END)"
            f" + (CASE Device_Fingerprint {dev} ELSE {D(0)} END)"
            f" + (CASE Webhook_Event {hook} ELSE {D(0)} END)")


def _tier_sql(x):
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= {D(0.8)} THEN 'Critical' WHEN {x} >= {D(0.6)} "
            f"THEN 'High' WHEN {x} >= {D(0.3)} THEN 'Medium' ELSE 'Low' END)")


def _explain_sql():
    L = "Donation_Amount >= a.amt_p75"
    conds = [
        f"Is_Night_Donation = 1 AND Is_Transfer = 1 AND {L}",
        f"High_Risk_Platform = 1 AND {L}",
        f"coalesce(Amt_LTV_Ratio > {D(C.EXPLAIN_RATIO)}, false)",
        "Low_Balance_Large_Gift = 1",
        f"Is_Round_Amount = 1 AND {L}",
        near_sql(),
        "Young_Large = 1",
        "Is_Withdrawal = 1 AND Donation_Amount >= a.amt_mean + 2 * a.amt_std_pop",
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip(conds, TR.EXPLANATIONS))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def with_risk(select: str) -> str:
    """Base CTEs + the risk CTEs; ``select`` may continue the CTE list with ", x AS (...)"."""
    actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TIER_ACTIONS.items())
    return with_base(f""", risk0 AS (
  SELECT l.*, {_boost_sql()} AS Partner_Boost, {_explain_sql()} AS Explanations FROM labeled l, anchors a
), risk1 AS (
  SELECT r.*, least(Score_Norm + Partner_Boost, {D(1.0)}) AS Risk_Score FROM risk0 r
), risk AS (
  SELECT r.*, {_tier_sql('Risk_Score')} AS Risk_Tier FROM risk1 r
), riskq AS (
  SELECT r.*, CASE Risk_Tier {actions} END AS Recommended_Action FROM risk r
)
{select}""")


def wr(select: str):
    return lambda: with_risk(select)


_QUEUE_COLS = ("Donation_ID, Donor_ID, Donor_Name, Donation_Amount, Currency, {rs} AS Risk_Score, Risk_Tier, "
               "Recommended_Action, Is_Anomalous, {fired} AS Fired_Rules, {expl} AS Explanations")


def _queue_sql(tiers, n):
    cols = _QUEUE_COLS.format(rs=q6("Risk_Score"), fired="array_to_string(Fired_Terms, ', ')",
                              expl="array_to_string(Explanations, '; ')")
    return (f"SELECT {cols} FROM riskq WHERE Risk_Tier IN {inlist(tiers)} "
            f"ORDER BY Risk_Score DESC, Donation_ID LIMIT {n}")


def queue_frame(spark, sf_dir, tiers=("Critical", "High"), n=30):
    q = TR.triage_queue(risk(spark, sf_dir), list(tiers), n)
    return q.select("Donation_ID", "Donor_ID", "Donor_Name", "Donation_Amount", "Currency",
                    r6("Risk_Score").alias("Risk_Score"), "Risk_Tier", "Recommended_Action", "Is_Anomalous",
                    F.array_join("Fired_Terms", ", ").alias("Fired_Rules"),
                    F.array_join("Explanations", "; ").alias("Explanations"))


@query("triage_queue", wr(_queue_sql(["Critical", "High"], 30)))
def triage_queue(spark, sf_dir):
    """L1 / T-g: Critical + High, score desc, top 30, with fired rules."""
    return queue_frame(spark, sf_dir)


@query("triage_queue_all_tiers", wr(_queue_sql(C.TIER_ORDER, 100)))
def triage_queue_all(spark, sf_dir):
    """Empty tier selection = all tiers; n = 100 (the control's maximum)."""
    return queue_frame(spark, sf_dir, C.TIER_ORDER, 100)


@query("risk_tiers", wr(f"SELECT Donation_ID, {q6('Risk_Score')} AS Risk_Score, Risk_Tier, Recommended_Action "
                        "FROM riskq"))
def risk_tiers(spark, sf_dir):
    return risk(spark, sf_dir).select("Donation_ID", r6("Risk_Score").alias("Risk_Score"), "Risk_Tier",
                                      "Recommended_Action")


@query("partner_boost", wr(f"SELECT Donation_ID, {q6('Partner_Boost')} AS Partner_Boost FROM riskq"))
def partner_boost(spark, sf_dir):
    return risk(spark, sf_dir).select("Donation_ID", r6("Partner_Boost").alias("Partner_Boost"))


@query("scorer_explanations", wr("SELECT Donation_ID, unnest(Explanations) AS explanation FROM riskq"))
def scorer_explanations(spark, sf_dir):
    return risk(spark, sf_dir).select("Donation_ID", F.explode("Explanations").alias("explanation"))


@query("tier_breakdown", wr(
    "SELECT t.Risk_Tier, t.tier_rank, coalesce(c.n, 0) AS n, "
    + q6("coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER ()") + " AS pct, "
    + q6("c.anomaly_rate") + " AS anomaly_rate FROM (VALUES "
    + ", ".join(f"('{t}', {i})" for i, t in enumerate(C.TIER_ORDER))
    + ") t(Risk_Tier, tier_rank) LEFT JOIN (SELECT Risk_Tier, count(*) AS n, avg(Is_Anomalous) AS anomaly_rate "
    "FROM riskq GROUP BY Risk_Tier) c ON t.Risk_Tier = c.Risk_Tier"))
def tier_breakdown(spark, sf_dir):
    t = TR.tier_breakdown(risk(spark, sf_dir))
    return t.select("Risk_Tier", "tier_rank", "n", r6("pct").alias("pct"), r6("anomaly_rate").alias("anomaly_rate"))


# ---------------------------------------------------------------- evaluation
_MODELS = {"rule": "Score_Norm", "boosted": "Risk_Score", "noisy": "Score_Noisy"}


def _long_scores(spark, sf_dir):
    r = risk(spark, sf_dir)
    return r.select("Is_Anomalous", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in _MODELS.items()])))


def _long_sql():
    return " UNION ALL ".join(f"SELECT '{m}' AS model, {c} AS score, Is_Anomalous FROM riskq"
                              for m, c in _MODELS.items())


def _cum_sql(src: str, by: str | None = None):
    part = f"PARTITION BY {by}" if by else ""
    gb = f"{by}, " if by else ""
    return (f"sc AS (SELECT {gb}score, CAST(sum(Is_Anomalous) AS BIGINT) AS tp_at, "
            f"CAST(sum(1 - Is_Anomalous) AS BIGINT) AS fp_at FROM ({src}) WHERE score IS NOT NULL GROUP BY ALL), "
            f"cum AS (SELECT *, CAST(sum(tp_at) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) "
            f"AS cum_tp, CAST(sum(fp_at) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) "
            f"AS cum_fp, CAST(sum(tp_at) OVER ({part}) AS BIGINT) AS P, "
            f"CAST(sum(fp_at) OVER ({part}) AS BIGINT) AS N FROM sc), "
            f"pts AS (SELECT *, cum_tp / (cum_tp + cum_fp) AS prec, cum_tp / P AS rec FROM cum), "
            f"fb AS (SELECT *, CASE WHEN {D(0.25)} * prec + rec > 0 THEN {D(1.25)} * prec * rec / "
            f"({D(0.25)} * prec + rec) ELSE {D(0)} END AS fbeta, (cum_tp - tp_at) < P AS on_curve FROM pts)")


def _metrics_select(by: str | None = None):
    gb = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT {gb}{q6('sum(fp_at * (cum_tp - tp_at / 2.0)) / (max(P) * max(N))')} AS roc_auc, "
            f"{q6('sum(tp_at / P * prec)')} AS average_precision, {q6('max(P) / (max(P) + max(N))')} AS base_rate, "
            f"{q6('max(opt_t)')} AS opt_threshold, {q6('max(opt_p)')} AS opt_precision, "
            f"{q6('max(opt_r)')} AS opt_recall, {q6('max(opt_f)')} AS opt_fbeta FROM ("
            f"SELECT *, first_value(CASE WHEN on_curve THEN score END) OVER w AS opt_t, "
            f"first_value(CASE WHEN on_curve THEN prec END) OVER w AS opt_p, "
            f"first_value(CASE WHEN on_curve THEN rec END) OVER w AS opt_r, "
            f"first_value(CASE WHEN on_curve THEN fbeta END) OVER w AS opt_f FROM fb "
            f"WINDOW w AS ({part}ORDER BY on_curve DESC, fbeta DESC, score ASC "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) {grp}")


def _round_metrics(df, by=()):
    cols = ["roc_auc", "average_precision", "base_rate", "opt_threshold", "opt_precision", "opt_recall",
            "opt_fbeta"]
    return df.select(*by, *[r6(c).alias(c) for c in cols])


@query("pr_curve", wr(f", {_cum_sql('SELECT Score_Norm AS score, Is_Anomalous FROM riskq')} "
                      f"SELECT {q6('score')} AS threshold, cum_tp, cum_fp, {q6('prec')} AS precision, "
                      f"{q6('rec')} AS recall FROM pts WHERE (cum_tp - tp_at) < P "
                      "UNION ALL SELECT NULL, 0, 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"))
def pr_curve(spark, sf_dir):
    """V1 for the rule score."""
    pr = EV.pr_points(risk(spark, sf_dir), "Score_Norm", "Is_Anomalous")
    return pr.select(r6("threshold").alias("threshold"), "cum_tp", "cum_fp",
                     r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("roc_curve", wr(f", {_cum_sql('SELECT Score_Norm AS score, Is_Anomalous FROM riskq')} "
                       f"SELECT {q6('score')} AS threshold, {q6('cum_fp / N')} AS fpr, {q6('cum_tp / P')} AS tpr "
                       "FROM cum UNION ALL SELECT NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)"))
def roc_curve(spark, sf_dir):
    """V2 for the rule score."""
    roc = EV.roc_points(risk(spark, sf_dir), "Score_Norm", "Is_Anomalous")
    return roc.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("roc_auc_ap_fbeta", wr(f", {_cum_sql('SELECT Score_Norm AS score, Is_Anomalous FROM riskq')} "
                              + _metrics_select()))
def roc_auc_ap_fbeta(spark, sf_dir):
    """V3, V4, V5 (beta 0.5) and V10 for the rule score in one pass."""
    return _round_metrics(EV.summary_metrics(risk(spark, sf_dir), "Score_Norm", "Is_Anomalous"))


@query("model_comparison", wr(f", {_cum_sql(_long_sql(), 'model')} " + _metrics_select("model")))
def model_comparison(spark, sf_dir):
    """V7 / V8: the same metrics for rule, boosted and noisy scores."""
    m = EV.summary_metrics(_long_scores(spark, sf_dir), "score", "Is_Anomalous", by=["model"])
    return _round_metrics(m, ["model"])


def _opt_threshold_sql():
    return (f", {_cum_sql('SELECT Score_Norm AS score, Is_Anomalous FROM riskq')}, "
            "opt AS (SELECT score AS t FROM fb WHERE on_curve ORDER BY fbeta DESC, score ASC LIMIT 1) ")


def _opt_threshold(spark, sf_dir):
    m = EV.summary_metrics(risk(spark, sf_dir), "Score_Norm", "Is_Anomalous").first()
    return m["opt_threshold"]


@query("confusion_matrix", wr(_opt_threshold_sql() + (
    "SELECT count_if(Score_Norm < t AND Is_Anomalous = 0) AS tn, count_if(Score_Norm >= t AND Is_Anomalous = 0) AS fp, "
    "count_if(Score_Norm < t AND Is_Anomalous = 1) AS fn, count_if(Score_Norm >= t AND Is_Anomalous = 1) AS tp "
    "FROM riskq, opt")))
def confusion_matrix(spark, sf_dir):
    """A25 at the F-0.5 optimal threshold of the rule score."""
    t = _opt_threshold(spark, sf_dir)
    return EV.confusion(risk(spark, sf_dir), F.col("Score_Norm"), "Is_Anomalous", t).select("tn", "fp", "fn", "tp")


@query("class_report", wr(_opt_threshold_sql() + (
    "SELECT cls, n_true AS support, " + q6("coalesce(tp / nullif(tp + fp, 0), 0)") + " AS precision, "
    + q6("coalesce(tp / nullif(tp + fn, 0), 0)") + " AS recall, "
    + q6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)") + " AS f1 FROM ("
    "SELECT 1 AS cls, count_if(Is_Anomalous = 1) AS n_true, count_if(p = 1 AND Is_Anomalous = 1) AS tp, "
    "count_if(p = 1 AND Is_Anomalous = 0) AS fp, count_if(p = 0 AND Is_Anomalous = 1) AS fn "
    "FROM (SELECT *, CAST(Score_Norm >= t AS INTEGER) AS p FROM riskq, opt) UNION ALL "
    "SELECT 0, count_if(Is_Anomalous = 0), count_if(p = 0 AND Is_Anomalous = 0), "
    "count_if(p = 0 AND Is_Anomalous = 1), count_if(p = 1 AND Is_Anomalous = 0) "
    "FROM (SELECT *, CAST(Score_Norm >= t AS INTEGER) AS p FROM riskq, opt))")))
def class_report(spark, sf_dir):
    """V6: precision / recall / F1 / support per class at the optimal threshold."""
    t = _opt_threshold(spark, sf_dir)
    r = risk(spark, sf_dir)
    pred = (F.col("Score_Norm") >= F.lit(t)).cast("int")
    y = F.col("Is_Anomalous")
    rows = []
    for cls in (1, 0):
        agg = r.agg(F.count_if(y == cls).alias("support"), F.count_if((pred == cls) & (y == cls)).alias("tp"),
                    F.count_if((pred == cls) & (y != cls)).alias("fp"),
                    F.count_if((pred != cls) & (y == cls)).alias("fn"))
        rows.append(agg.select(F.lit(cls).alias("cls"), "support",
                               r6(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).alias("precision"),
                               r6(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))).alias("recall"),
                               r6(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                                             F.lit(0.0))).alias("f1")))
    return rows[0].unionByName(rows[1])


def _sweep_sql():
    s = "Risk_Score"
    k = (f"least(greatest(CASE WHEN {s} >= (floor({s} * 100) + 1) / 100.0 THEN floor({s} * 100) + 1 "
         f"WHEN {s} < floor({s} * 100) / 100.0 THEN floor({s} * 100) - 1 ELSE floor({s} * 100) END, 9), 90)")
    return (f", g AS (SELECT k, count_if(Risk_Score >= k / 100.0 AND Is_Anomalous = 1) AS tp, "
            f"count_if(Risk_Score >= k / 100.0 AND Is_Anomalous = 0) AS fp, count_if(Is_Anomalous = 1) AS P, "
            f"count_if(Is_Anomalous = 0) AS N FROM riskq, range(10, 91) r(k) GROUP BY k) "
            f"SELECT {q6('k / 100.0')} AS threshold, tp, fp, P - tp AS fn, N - fp AS tn, "
            f"{q6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {q6('coalesce(tp / nullif(P, 0), 0)')} "
            "AS recall FROM g").replace("{k}", k)


@query("threshold_sweep", wr(_sweep_sql()))
def threshold_sweep(spark, sf_dir):
    """V9: thresholds .10-.90 step .01 on the boosted risk score."""
    t = EV.threshold_sweep(risk(spark, sf_dir), "Risk_Score", "Is_Anomalous")
    return t.select(r6("threshold").alias("threshold"), "tp", "fp", "fn", "tn",
                    r6("precision").alias("precision"), r6("recall").alias("recall"))


def _metric_query(cols):
    def sql():
        return with_risk(f", {_cum_sql('SELECT Score_Norm AS score, Is_Anomalous FROM riskq')}, "
                         f"mt AS ({_metrics_select()}) SELECT {', '.join(cols)} FROM mt")
    return sql


@query("roc_auc", _metric_query(["roc_auc"]))
def roc_auc(spark, sf_dir):
    """V3: ROC AUC of the rule score (ties count half)."""
    return roc_auc_ap_fbeta(spark, sf_dir).select("roc_auc")


@query("average_precision", _metric_query(["average_precision", "base_rate"]))
def average_precision(spark, sf_dir):
    """Average precision and the random-baseline rate."""
    return roc_auc_ap_fbeta(spark, sf_dir).select("average_precision", "base_rate")


@query("fbeta_threshold", _metric_query(["opt_threshold", "opt_precision", "opt_recall", "opt_fbeta"]))
def fbeta_threshold(spark, sf_dir):
    """V5: F-0.5 optimal threshold (lowest threshold on ties) with its precision,
    recall and F-beta."""
    return roc_auc_ap_fbeta(spark, sf_dir).select("opt_threshold", "opt_precision", "opt_recall", "opt_fbeta")
