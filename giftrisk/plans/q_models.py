"""Model queries (M1-M13). Encoding, weights, split and scaling statistics are
exact (oracle-checked); trained-model outputs are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import evaluate as EV
from giftrisk.operators import models as M
from giftrisk.plans.oracle import with_base
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.registry import q6, query, r6
from giftrisk.session import write_stage

P = Pipeline.get
Y = "Is_Anomalous"
_SPLIT_DRAW = "('0x' || substr(md5(Donation_ID || '|split'), 1, 15))::BIGINT"


def split_table(spark, sf_dir):
    """Encoded model table with the stratified ``is_test`` flag (materialised
    once per pipeline)."""
    return P(spark, sf_dir).model_split()


def model_table(spark, sf_dir):
    return split_table(spark, sf_dir).drop("is_test")


@query("label_encode", lambda: with_base(
    "SELECT Donation_ID, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}"
                                       for c in C.CAT_ENCODE) + " FROM features"))
def label_encode(spark, sf_dir):
    """M1: 13 sorted-string label encodings."""
    return model_table(spark, sf_dir).select("Donation_ID", *C.CAT_ENCODE)


@query("class_weights", lambda: with_base(
    "SELECT Is_Anomalous, count(*) AS n_c, " + q6("(SELECT count(*) FROM labeled) / (2.0 * count(*))")
    + " AS weight FROM labeled GROUP BY Is_Anomalous"))
def class_weights(spark, sf_dir):
    """M4: balanced class weights."""
    w = M.class_weights(model_table(spark, sf_dir))
    return w.select(Y, "n_c", r6("weight").alias("weight"))


@query("stratified_split", lambda: with_base(
    ", r AS (SELECT Is_Anomalous, row_number() OVER (PARTITION BY Is_Anomalous ORDER BY " + _SPLIT_DRAW
    + ", Donation_ID) AS rn, count(*) OVER (PARTITION BY Is_Anomalous) AS n_c FROM labeled) "
    "SELECT Is_Anomalous, CAST(rn <= round(0.2 * n_c) AS INTEGER) AS is_test, count(*) AS n FROM r GROUP BY ALL"))
def stratified_split(spark, sf_dir):
    """M2: stratified 80/20 split with exact per-class test counts."""
    return split_table(spark, sf_dir).groupBy(Y, "is_test").agg(F.count("*").alias("n"))


_STD_COLS = ["Log_Donation_Amount", "Log_Donor_Lifetime_Value", "Age", "Donor_Since_Days", "IP_Velocity_24h"]


@query("standardise", lambda: with_base(
    ", r AS (SELECT *, row_number() OVER (PARTITION BY Is_Anomalous ORDER BY " + _SPLIT_DRAW
    + ", Donation_ID) AS rn, count(*) OVER (PARTITION BY Is_Anomalous) AS n_c FROM labeled), tr AS (SELECT *, "
    "ln(1 + Donation_Amount) AS Log_Donation_Amount, ln(1 + Donor_Lifetime_Value) AS Log_Donor_Lifetime_Value "
    "FROM r WHERE rn > round(0.2 * n_c)) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {q6(f'avg({c})')} AS mean, {q6(f'stddev_pop({c})')} AS std FROM tr"
        for c in _STD_COLS)))
def standardise(spark, sf_dir):
    """M3: scaler statistics fitted on the training rows only (population std,
    as the reference scaler; MLlib's StandardScaler uses the sample std)."""
    tr = split_table(spark, sf_dir).where(F.col("is_test") == 0)
    wide = tr.agg(*[x for c in _STD_COLS for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), r6(f"{c}__m").alias("mean"),
                                                   r6(f"{c}__s").alias("std")) for c in _STD_COLS])))


def _train_test(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return s.where(F.col("is_test") == 0), s.where(F.col("is_test") == 1)


@query("rf_scores")
def rf_scores(spark, sf_dir):
    """Random-forest positive-class probability on the test rows (the
    forest is fitted once per pipeline, saved and loaded)."""
    _, te = _train_test(spark, sf_dir)
    return M.positive_probability(P(spark, sf_dir).forest().transform(te)).select("Donation_ID", Y, "score")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Impurity importances, ranked, with top-5 / 6-10 / rest bands."""
    rf = P(spark, sf_dir).forest().stages[-1]
    imp = [(f, float(v)) for f, v in zip(C.MODEL_FEATURES, rf.featureImportances.toArray())]
    df = spark.createDataFrame(imp, "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), "feature")  # 48 rows
    rank = F.row_number().over(w)
    return df.select("feature", "importance", rank.alias("rank"),
                     F.when(rank <= 5, "top5").when(rank <= 10, "top10").otherwise("rest").alias("band"))


@query("lr_calibrated_scores")
def lr_calibrated_scores(spark, sf_dir):
    """M6 / M7: logistic regression with 5-fold isotonic calibration."""
    return P(spark, sf_dir).risk_scores("LR").select("Donation_ID", F.col("LR_Score").alias("score"), Y)


@query("iso_scores")
def iso_scores(spark, sf_dir):
    """M8 / M9: isolation-forest anomaly score and the contamination cut
    (exact train-score quantile at 1 - 0.055)."""
    r = P(spark, sf_dir).risk_scores("IF")
    return r.select("Donation_ID", Y, F.col("IF_Score").alias("score"), F.col("IF_Flag").alias("iso_flag"))


def _forest_threshold(spark, sf_dir) -> float:
    """The forest's F-0.5 threshold on the whole test set."""
    return EV.summary_metrics(P(spark, sf_dir).risk_scores("RF"), "RF_Score", Y).first()["opt_threshold"]


@query("risk_table")
def risk_table(spark, sf_dir):
    """One table with the three models' scores, the forest's prediction at its
    F-0.5 threshold, and the tier of the boosted score."""
    from giftrisk.operators import triage as TR
    raw = ["CVV_Check", "Device_Fingerprint", "Webhook_Event"]
    lab = P(spark, sf_dir).labeled().select("Donation_ID", "Donor_ID", *raw)
    r = P(spark, sf_dir).risk_scores().join(lab, "Donation_ID")
    r = r.withColumn("Risk_Score", TR.boosted_score(F.col("RF_Score"))).withColumn("Risk_Tier", TR.risk_tier(F.col("Risk_Score")))
    flag = (F.col("RF_Score") >= F.lit(_forest_threshold(spark, sf_dir))).cast("int")
    return r.withColumn("Predicted", flag).select("Donation_ID", "Donor_ID", Y, "RF_Score", "LR_Score", "IF_Score", "IF_Flag",
                                                  "Risk_Score", "Risk_Tier", "Predicted")


@query("model_metrics")
def model_metrics(spark, sf_dir):
    """V7 / K2: AUC, AP and, at each model's F-0.5 threshold, confusion counts,
    precision, recall and F1 of the three trained models."""
    r = P(spark, sf_dir).risk_scores()
    long = r.select(Y, F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in (
        ("Random Forest", "RF_Score"), ("Logistic Regression", "LR_Score"), ("Isolation Forest", "IF_Score"))])))
    m = EV.summary_metrics(long, "score", Y, by=["model"])
    at = long.join(F.broadcast(m.select("model", "opt_threshold")), "model")  # three rows
    return m.join(EV.confusion(at, F.col("score"), Y, F.col("opt_threshold"), by=["model"]), "model")


@query("cv_metrics")
def cv_metrics(spark, sf_dir):
    """Cross-validated AUC, AP and F1 (at 0.5) of the forest over stratified
    folds (mean and sd)."""
    mt = M.stratified_folds(model_table(spark, sf_dir), 5)
    parts = []
    for k in range(5):
        model = M.fit_random_forest(mt.where(F.col("_fold") != k).drop("_fold"), C.CV_TREES, C.CV_DEPTH, C.CV_MIN_LEAF)
        sc = M.positive_probability(model.transform(mt.where(F.col("_fold") == k))).select(F.lit(k).alias("fold"), "score", Y)
        parts.append(write_stage(sc, "cv_fold"))
    sc = parts[0]
    for p in parts[1:]:
        sc = sc.unionByName(p)
    m = EV.summary_metrics(sc, "score", Y, by=["fold"]).join(EV.confusion(sc, F.col("score"), Y, 0.5, by=["fold"]), "fold")
    return m.agg(*[f(c).alias(f"{n}_{s}") for n, c in (("auc", "roc_auc"), ("ap", "average_precision"), ("f1", "f1"))
                   for s, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def _honest_sql():
    from giftrisk.plans.oracle import u
    from giftrisk.plans.q_triage import _cum_sql
    split = (", sp AS (SELECT Donation_ID, Score_Norm, Is_Anomalous, row_number() OVER (PARTITION BY Is_Anomalous "
             "ORDER BY " + _SPLIT_DRAW + ", Donation_ID) <= round(0.2 * count(*) OVER (PARTITION BY Is_Anomalous)) "
             "AS is_test FROM labeled)")
    val = f"SELECT Score_Norm AS score, Is_Anomalous FROM sp WHERE NOT is_test AND {u('Donation_ID', 'val', 0)} < 0.25"
    return with_base(
        split + f", {_cum_sql(val)}, opt AS (SELECT score AS t FROM fb WHERE on_curve ORDER BY fbeta DESC, score "
        "LIMIT 1) SELECT " + q6("t") + " AS threshold, count_if(Score_Norm >= t AND Is_Anomalous = 1) AS tp, "
        "count_if(Score_Norm >= t AND Is_Anomalous = 0) AS fp, count_if(Score_Norm < t AND Is_Anomalous = 1) AS fn, "
        "count_if(Score_Norm < t AND Is_Anomalous = 0) AS tn FROM sp, opt WHERE is_test GROUP BY t")


@query("honest_threshold", _honest_sql)
def honest_threshold(spark, sf_dir):
    """D14 honest mode: the F-0.5 threshold is chosen on a validation quarter
    of the training rows and the confusion counts are reported on the
    untouched test split (the parity mode tunes on the test set itself)."""
    from giftrisk.functions.draws import uniform
    from giftrisk.operators import evaluate as EV
    lab = P(spark, sf_dir).labeled().select("Donation_ID", "Score_Norm", Y)
    s = M.stratified_split(lab)
    val = s.where((F.col("is_test") == 0) & (uniform(F.col("Donation_ID"), "val", 0) < 0.25))
    t = EV.summary_metrics(val, "Score_Norm", Y).first()["opt_threshold"]
    cm = EV.confusion(s.where(F.col("is_test") == 1), F.col("Score_Norm"), Y, t)
    return cm.select(r6(F.lit(t)).alias("threshold"), "tp", "fp", "fn", "tn")


@query("two_step_scoring")
def two_step_scoring(spark, sf_dir):
    """T-d: new donations (the test split) are screened first; blocked donors
    are hard-blocked without consulting the model (left semi), the rest are
    scored by the random forest, boosted by the partner signals, capped at 1,
    tiered and flagged at the forest's F-0.5 threshold (left anti path)."""
    from giftrisk.operators import screening as SC
    from giftrisk.operators import triage as TR
    from giftrisk.plans.q_screen import donor_names, entities
    _, te = _train_test(spark, sf_dir)
    raw = ["CVV_Check", "Device_Fingerprint", "Webhook_Event"]  # te holds their encoded model inputs
    lab = P(spark, sf_dir).labeled().select("Donation_ID", "Donor_ID", *[F.col(c).alias(f"_raw_{c}") for c in raw])
    new = te.join(lab, "Donation_ID")
    blocked_ids = SC.fuzzy_hits(donor_names(spark, sf_dir), entities(spark, sf_dir)).select(
        F.col("name_id").alias("Donor_ID")).distinct()
    blocked, rest = SC.split_blocked(new, blocked_ids)
    scored = M.positive_probability(P(spark, sf_dir).forest().transform(rest)).select(
        "Donation_ID", "Donor_ID", "score", Y, *[F.col(f"_raw_{c}").alias(c) for c in raw])
    t = _forest_threshold(spark, sf_dir)  # tuned on the whole test set, blocked donors too
    scored = (scored.withColumn("Risk_Score", TR.boosted_score(F.col("score")))
              .withColumn("Risk_Tier", TR.risk_tier(F.col("Risk_Score")))
              .withColumn("status", F.lit("SCORED"))
              .withColumn("flagged", (F.col("Risk_Score") >= F.lit(t)).cast("int")))
    out_cols = ["Donation_ID", "Donor_ID", "status", "Risk_Score", "Risk_Tier", "flagged"]
    hard = blocked.select("Donation_ID", "Donor_ID", F.lit("BLOCKED").alias("status"),
                          F.lit(None).cast("double").alias("Risk_Score"), F.lit(None).cast("string").alias("Risk_Tier"),
                          F.lit(1).alias("flagged"))
    return scored.select(*out_cols).unionByName(hard)
