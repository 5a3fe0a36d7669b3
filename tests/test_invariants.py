"""Invariants from the survey's test strategy: enrichment draws follow their
configured probabilities, PR recall is monotone, blocked and scored donations
are disjoint."""
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import evaluate as EV
from giftrisk.operators import screening as SC
from giftrisk.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.01"


def _share(df, cond):
    return df.agg(F.avg(F.when(cond, 1.0).otherwise(0.0))).first()[0]


def test_enrichment_rates_follow_configuration(spark):
    d = Pipeline.get(spark, SF).donations()
    n = d.count()
    tol = 4 * (0.25 / n) ** 0.5 + 0.005  # ~4 sd of a proportion, plus slack
    card = d.where(F.col("Donation_Platform").isin(C.CARD_PLATFORMS))
    assert abs(_share(card, F.col("CVV_Check") == "Fail") - (1 - C.CVV_PASS)) < tol * 2
    assert _share(d.where(~F.col("Donation_Platform").isin(C.CARD_PLATFORMS)), F.col("CVV_Check") == "N/A") == 1.0
    assert abs(_share(d, F.col("Webhook_Event") == "payment.authorised") - 0.91) < tol
    assert abs(_share(d, F.col("Device_Fingerprint") == "Known Flagged") - 0.03) < tol
    for cid, _, w in C.CAMPAIGNS:
        assert abs(_share(d, F.col("Campaign_ID") == cid) - w) < tol
    for f, w in C.FREQUENCIES:
        assert abs(_share(d, F.col("Donation_Frequency") == f) - w) < tol
    assert d.where((F.col("Donation_Frequency") == "First-time") & (F.col("Donor_Since_Days") != 0)).count() == 0
    assert d.where(F.col("Donor_Since_Days") > C.TENURE_MAX).count() == 0
    uk = d.where(F.col("Donor_Country") == "UK")
    assert abs(_share(uk, F.col("Gift_Aid_Eligible") == 1) - C.GIFT_AID_UK) < tol * 2
    assert d.where((F.col("Donor_Country") != "UK") & (F.col("Gift_Aid_Eligible") == 1)).count() == 0


def test_pr_recall_monotone_and_precision_bounded(spark):
    lab = Pipeline.get(spark, SF).labeled()
    pr = EV.pr_points(lab, "Score_Norm", "Is_Anomalous").orderBy(F.col("threshold").desc_nulls_first()).collect()
    rec = [r["recall"] for r in pr]
    assert rec == sorted(rec) and rec[-1] <= 1.0
    assert all(0.0 <= r["precision"] <= 1.0 for r in pr)


def test_blocked_and_scored_are_disjoint(spark):
    from giftrisk.plans.q_screen import donor_names, entities
    p = Pipeline.get(spark, SF)
    d = p.donations()
    blocked = SC.fuzzy_hits(donor_names(spark, SF), entities(spark, SF)).select(
        F.col("name_id").alias("Donor_ID")).distinct()
    b, rest = SC.split_blocked(d, blocked)
    assert b.join(rest, "Donation_ID").count() == 0
    assert b.count() + rest.count() == d.count()


def test_running_totals_over_thousands_of_ranges(spark):
    import random
    rng = random.Random(4)
    rows = [(i / 6000, rng.randint(0, 1)) for i in range(6000)]
    g = EV.score_counts(spark.createDataFrame(rows, "s double, y int"), "s", "y")
    got = {r.score: (r.cum_tp, r.cum_fp) for r in EV.running_totals(g, [], 2000).collect()}
    tp = fp = 0
    for s, y in sorted(rows, reverse=True):
        tp, fp = tp + y, fp + 1 - y
        assert got[s] == (tp, fp)
