"""Weighted compliance rules (R1-R20), flag count (A24), score and the list of
fired terms.

Weights are multiples of 0.1, so the score is kept as an exact integer number of
tenths (``Rule_Score_10``) and ``Rule_Score`` = tenths / 10. Each rule group is
its own int column (explainable, and it keeps the generated code per column
small); the score sums the 20 group columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators.features import Anchors, amt_ltv_ratio, near_threshold, parse_hour


@dataclass(frozen=True)
class Term:
    rule: str        # rule group id, R1..R20
    term: str        # term id
    tenths: int      # weight x 10
    pred: Callable[["Ctx"], Column]


class Ctx:
    """Named masks shared by the rule terms (computed once per row)."""

    def __init__(self, a: Anchors):
        amt = F.col("Donation_Amount")
        self.a = a
        self.amt = amt
        self.large = amt >= F.lit(a.amt_p75)
        self.ge90 = amt >= F.lit(a.amt_p90)
        self.ge95 = amt >= F.lit(a.amt_p95)
        self.anon = F.col("Is_Anonymous") == 1
        self.first = F.col("Donation_Frequency") == "First-time"
        self.refund = F.col("Refund_Requested") == 1
        self.cvv_fail = F.col("CVV_Check") == "Fail"
        self.flagged = F.col("Device_Fingerprint") == "Known Flagged"
        self.hi_risk = F.col("Donation_Platform").isin(C.HIGH_RISK_PLATFORMS_RULE)
        hour = F.col("_hour")
        self.night = F.coalesce(hour.between(*C.NIGHT_HOURS), F.lit(False))
        self.xfer = F.col("Donation_Type") == "Bank Transfer"
        self.round = (amt % C.ROUND_MODULUS) == 0
        self.emergency = F.col("Campaign_ID") == C.EMERGENCY_CAMPAIGN
        self.cold = F.col("Acquisition_Channel") == "Cold Outreach"
        self.corp = F.col("Donor_Segment") == "Corporate"
        self.matched = F.col("Matched_Giving") == 1
        self.weekend = F.coalesce(F.weekday("Donation_Date") >= 5, F.lit(False))
        self.mism = F.col("IP_Country_Match") == 0
        self.vpn = F.col("Is_VPN_Or_Proxy") == 1
        self.v3 = F.col("IP_Velocity_24h") >= 3
        self.v5 = F.col("IP_Velocity_24h") >= 5
        self.ratio = F.col("_ratio")
        self.webhook = F.col("Webhook_Event")


def _near(t: int) -> Callable[[Ctx], Column]:
    return lambda c: (c.amt >= F.lit(t * C.NEAR_THRESHOLD_BAND)) & (c.amt < F.lit(float(t)))


# FIXED VALUES: rule terms and weights (in tenths)
TERMS: list[Term] = [
    Term("R1", "refund", 30, lambda c: c.refund),
    Term("R1", "refund_large", 15, lambda c: c.refund & c.large),
    Term("R2", "anon_large", 22, lambda c: c.anon & c.large),
    Term("R2", "anon_p95", 15, lambda c: c.anon & c.ge95),
    Term("R3", "first_p90", 20, lambda c: c.first & c.ge90),
    Term("R3", "first_new_large", 12,
         lambda c: c.first & (F.col("Donor_Since_Days") == 0) & c.large),
    Term("R4", "cvv_fail", 28, lambda c: c.cvv_fail),
    Term("R4", "cvv_fail_large", 10, lambda c: c.cvv_fail & c.large),
    Term("R5", "device_flagged", 30, lambda c: c.flagged),
    Term("R5", "device_flagged_large", 12, lambda c: c.flagged & c.large),
    Term("R6", "chargeback", 35, lambda c: c.webhook == "chargeback.received"),
    Term("R6", "reversed", 20, lambda c: c.webhook == "payment.reversed"),
    Term("R6", "reversed_large", 15, lambda c: (c.webhook == "payment.reversed") & c.large),
    Term("R7", "high_risk_platform", 8, lambda c: c.hi_risk),
    Term("R7", "high_risk_platform_large", 16, lambda c: c.hi_risk & c.large),
    Term("R8", "ratio_p90", 18, lambda c: F.coalesce(c.ratio > F.lit(c.a.ratio_p90), F.lit(False))),
    Term("R8", "ratio_2p90", 12, lambda c: F.coalesce(c.ratio > F.lit(c.a.ratio_p90 * 2), F.lit(False))),
    Term("R8", "low_ltv_large", 20,
         lambda c: (F.col("Donor_Lifetime_Value") < F.lit(c.a.ltv_p10)) & c.large),
    Term("R9", "night_transfer_large", 22, lambda c: c.night & c.xfer & c.large),
    Term("R9", "night_large", 6, lambda c: c.night & c.large),
    Term("R10", "round_p90", 15, lambda c: c.round & c.ge90),
    Term("R10", "round_p95", 10, lambda c: c.round & c.ge95),
    Term("R11", "emergency_anon_large", 12, lambda c: c.emergency & c.anon & c.large),
    Term("R11", "emergency_first_p90", 8, lambda c: c.emergency & c.first & c.ge90),
    Term("R12", "cold_large_first", 18, lambda c: c.cold & c.large & c.first),
    Term("R12", "cold_p95", 12, lambda c: c.cold & c.ge95),
    Term("R13", "corporate_night_transfer_large", 20, lambda c: c.corp & c.night & c.xfer & c.large),
    Term("R14", "matched_anon", 15, lambda c: c.matched & c.anon),
    Term("R14", "matched_first_p90", 10, lambda c: c.matched & c.first & c.ge90),
    Term("R15", "near_500", 12, _near(500)),
    Term("R15", "near_750", 12, _near(750)),
    Term("R15", "near_900", 12, _near(900)),
    Term("R15", "near_950", 12, _near(950)),
    Term("R16", "weekend_night_first_large", 18, lambda c: c.weekend & c.night & c.first & c.large),
    Term("R17", "ip_mismatch", 12, lambda c: c.mism),
    Term("R17", "ip_mismatch_large", 10, lambda c: c.mism & c.large),
    Term("R17", "ip_mismatch_first_large", 15, lambda c: c.mism & c.first & c.large),
    Term("R17", "ip_mismatch_refund", 18, lambda c: c.mism & c.refund),
    Term("R18", "vpn", 10, lambda c: c.vpn),
    Term("R18", "vpn_large", 12, lambda c: c.vpn & c.large),
    Term("R18", "vpn_anon", 15, lambda c: c.vpn & c.anon),
    Term("R18", "vpn_cvv_fail", 20, lambda c: c.vpn & c.cvv_fail),
    Term("R18", "vpn_mismatch", 10, lambda c: c.vpn & c.mism),
    Term("R19", "velocity_3", 15, lambda c: c.v3),
    Term("R19", "velocity_5", 20, lambda c: c.v5),
    Term("R19", "velocity_5_cvv_fail", 15, lambda c: c.v5 & c.cvv_fail),
    Term("R19", "velocity_3_large", 12, lambda c: c.v3 & c.large),
    Term("R20", "flags_3", 20, lambda c: F.col("Flag_Count") >= 3),
    Term("R20", "flags_4", 15, lambda c: F.col("Flag_Count") >= 4),
]
RULE_IDS = [f"R{i}" for i in range(1, 21)]


def flag_count(c: Ctx) -> Column:
    """Row-wise count of 11 individual red flags."""
    flags = [c.refund, c.anon, c.first, c.cvv_fail, c.flagged, c.hi_risk, c.night, c.cold,
             c.mism, c.vpn, c.v3]
    total = None
    for f in flags:
        total = f.cast("int") if total is None else total + f.cast("int")
    return total


def score_rules(donations: DataFrame, a: Anchors, keep_terms: bool = True) -> DataFrame:
    """Adds Flag_Count, one int column per rule group (tenths), Rule_Score_10,
    Rule_Score and, with ``keep_terms``, the array of fired term ids."""
    amt, ltv = F.col("Donation_Amount"), F.col("Donor_Lifetime_Value")
    df = donations.withColumns({"_hour": parse_hour(F.col("Donation_Time")),
                                "_ratio": amt_ltv_ratio(amt, ltv)})
    c = Ctx(a)
    df = df.withColumn("Flag_Count", flag_count(c))
    # the 49 predicates are evaluated once into one int array; group sums and
    # the fired list read it. One fused projection of 49 predicates x 2 uses
    # generates a method above the JIT size limit and runs interpreted.
    # Without the list, the array holds the 20 group sums.
    groups = {}
    if keep_terms:
        df = df.withColumn("_t", F.array(*[F.coalesce(t.pred(c), F.lit(False)).cast("int") for t in TERMS]))
        for i, t in enumerate(TERMS):
            v = F.col("_t")[i] * F.lit(t.tenths)
            groups[t.rule] = v if t.rule not in groups else groups[t.rule] + v
    else:
        sums = {}
        for t in TERMS:
            v = F.when(t.pred(c), F.lit(t.tenths)).otherwise(F.lit(0))
            sums[t.rule] = v if t.rule not in sums else sums[t.rule] + v
        df = df.withColumn("_t", F.array(*[sums[r] for r in RULE_IDS]))
        groups = {r: F.col("_t")[i] for i, r in enumerate(RULE_IDS)}
    df = df.withColumns({f"{r}_10": groups[r] for r in RULE_IDS})
    total = None
    for r in RULE_IDS:
        total = F.col(f"{r}_10") if total is None else total + F.col(f"{r}_10")
    df = df.withColumn("Rule_Score_10", total)
    df = df.withColumn("Rule_Score", F.col("Rule_Score_10") / 10.0)
    if keep_terms:
        names = F.array(*[F.lit(t.term) for t in TERMS])
        fired = F.transform(F.col("_t"), lambda v, i: F.when(v == 1, names[i]))
        df = df.withColumn("Fired_Terms", F.filter(fired, lambda x: x.isNotNull()))
    df = df.drop("_t")
    return df.drop("_hour", "_ratio")


def fire_rules(donations: DataFrame, a: Anchors) -> DataFrame:
    """Adds _hour, Flag_Count, ``_fired`` (the k-th of TERMS fired: bit k of a long) and
    ``_tenths`` (Rule_Score_10): what ``rule_columns`` needs of a row."""
    df = donations.withColumns({"_hour": parse_hour(F.col("Donation_Time")),
                                "_ratio": amt_ltv_ratio(F.col("Donation_Amount"), F.col("Donor_Lifetime_Value"))})
    c = Ctx(a)
    df = df.withColumn("Flag_Count", flag_count(c))
    fired = None
    for i, t in enumerate(TERMS):
        bit = F.when(t.pred(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        fired = bit if fired is None else fired + bit
    df = df.withColumn("_fired", fired).drop("_ratio")
    total = None
    for v in _bit_sums().values():
        total = v if total is None else total + v
    return df.withColumn("_tenths", total)


def rule_score() -> Column:
    """Rule_Score from ``_tenths``."""
    return F.col("_tenths") / 10.0


def _bit_sums() -> dict[str, Column]:
    """Tenths per rule group, read from ``_fired``."""
    sums = {}
    for i, t in enumerate(TERMS):
        v = F.getbit("_fired", F.lit(i)).cast("int") * F.lit(t.tenths)
        sums[t.rule] = v if t.rule not in sums else sums[t.rule] + v
    return {r: sums[r] for r in RULE_IDS}


def rule_columns(fired: DataFrame, keep: list[str], after: list[str]) -> DataFrame:
    """``keep``, the columns of ``score_rules`` from those of ``fire_rules``, each an
    expression of one stored number, and ``after``."""
    names = F.array(*[F.lit(t.term) for t in TERMS])
    terms = F.filter(names, lambda _, i: F.getbit("_fired", i) == 1)
    return fired.select(*keep, "Flag_Count", *[v.alias(f"{r}_10") for r, v in _bit_sums().items()],
                        F.col("_tenths").alias("Rule_Score_10"), rule_score().alias("Rule_Score"), terms.alias("Fired_Terms"), *after)


def validation_masks(c: Ctx) -> list[tuple[str, Column]]:
    """The 25 masks of the rule-validation (lift) table, in report order."""
    # FIXED VALUES: report labels
    return [
        ("Refund requested", c.refund),
        ("Refund + large amount", c.refund & c.large),
        ("Anonymous + large", c.anon & c.large),
        ("First-time + ≥p90 amount", c.first & c.ge90),
        ("CVV fail", c.cvv_fail),
        ("Known flagged device", c.flagged),
        ("Chargeback webhook", c.webhook == "chargeback.received"),
        ("Payment reversed webhook", c.webhook == "payment.reversed"),
        ("High-risk platform + large", c.hi_risk & c.large),
        ("Donation >> lifetime value (p90)", F.coalesce(c.ratio > F.lit(c.a.ratio_p90), F.lit(False))),
        ("Night + transfer + large", c.night & c.xfer & c.large),
        ("Large round number", c.round & c.ge90),
        ("Cold outreach + large + first-time", c.cold & c.large & c.first),
        ("Corporate + night + transfer", c.corp & c.night & c.xfer),
        ("Matched giving + anonymous", c.matched & c.anon),
        ("Near-threshold structuring", near_threshold(c.amt)),
        ("3+ flags triggered", F.col("Flag_Count") >= 3),
        ("IP country mismatch", c.mism),
        ("IP mismatch + large", c.mism & c.large),
        ("VPN or proxy", c.vpn),
        ("VPN + anonymous", c.vpn & c.anon),
        ("VPN + CVV fail", c.vpn & c.cvv_fail),
        ("IP velocity >= 3 (card testing)", c.v3),
        ("IP velocity >= 5 (bot/attack)", c.v5),
        ("Baseline (all)", F.lit(True)),
    ]
