"""Anchors (A5, A8) and the per-row feature columns.

Anchors are a handful of scalars computed by one distributed pass each and
used as literals, so Catalyst folds them into the row expressions and every
feature stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Anchors:
    n: int
    amt_mean: float
    amt_std_pop: float
    amt_std_samp: float
    amt_p75: float
    amt_p90: float
    amt_p95: float
    ltv_p10: float
    ratio_p90: float

    def as_dict(self) -> dict:
        return asdict(self)


def amt_ltv_ratio(amount: Column, ltv: Column) -> Column:
    """amount / (ltv + 1); NULL instead of an error when ltv = -1."""
    return F.try_divide(amount, ltv + 1)


def compute_anchors(donations: DataFrame) -> Anchors:
    amt, ltv = F.col("Donation_Amount"), F.col("Donor_Lifetime_Value")
    ratio = amt_ltv_ratio(amt, ltv)
    m = donations.agg(F.count("*").alias("n"), F.avg(amt).alias("mean"),
                      F.stddev_pop(amt).alias("sp"), F.stddev_samp(amt).alias("ss"),
                      F.count(amt).alias("n_amt"), F.count(ltv).alias("n_ltv"), F.count(ratio).alias("n_ratio")).first()
    q = exact_quantiles(donations, {
        "amt_p75": (amt, 0.75), "amt_p90": (amt, 0.90), "amt_p95": (amt, 0.95),
        "ltv_p10": (ltv, 0.10), "ratio_p90": (ratio, 0.90),
    }, counts={"amt_p75": m["n_amt"], "amt_p90": m["n_amt"], "amt_p95": m["n_amt"], "ltv_p10": m["n_ltv"],
               "ratio_p90": m["n_ratio"]})
    return Anchors(n=int(m["n"]), amt_mean=m["mean"], amt_std_pop=m["sp"], amt_std_samp=m["ss"], **q)


def parse_hour(time_str: Column, pattern: str = "HH:mm:ss") -> Column:
    """Hour of a time string; NULL when it does not parse."""
    return F.hour(F.try_to_timestamp(time_str, F.lit(pattern)))


def parse_day_first(date_str: Column, pattern: str = "dd-MM-yyyy") -> Column:
    """Day-first date string -> date; NULL when it does not parse."""
    return F.to_date(F.try_to_timestamp(date_str, F.lit(pattern)))


def between_flag(x: Column, lo, hi) -> Column:
    """Inclusive range as 0/1; NULL input counts as 0 (NaN comparisons are false)."""
    return F.coalesce(x.between(lo, hi), F.lit(False)).cast("int")


def near_threshold(amount: Column, thresholds=C.STRUCTURING_THRESHOLDS,
                   band: float = C.NEAR_THRESHOLD_BAND) -> Column:
    """True when amount lies in [band*t, t) for any threshold t."""
    cond = F.lit(False)
    for t in thresholds:
        cond = cond | ((amount >= F.lit(t * band)) & (amount < F.lit(float(t))))
    return cond


def is_round(amount: Column, modulus: int = C.ROUND_MODULUS) -> Column:
    return (amount % modulus) == 0


def add_features(donations: DataFrame, a: Anchors, night=C.NIGHT_HOURS,
                 round_modulus: int = C.ROUND_MODULUS,
                 high_risk=C.HIGH_RISK_PLATFORMS_FEATURE, hour: Column | None = None) -> DataFrame:
    """The 35 numeric model inputs, plus Hour/DayOfWeek helpers. Night hours,
    round modulus and the platform list are parameters (the notebook variants
    use 0-5, 100 and a 3-platform list). ``hour``: the parsed hour, if at hand."""
    amt, ltv = F.col("Donation_Amount"), F.col("Donor_Lifetime_Value")
    df = donations.withColumns({
        "Hour": parse_hour(F.col("Donation_Time")) if hour is None else hour,
        "DayOfWeek": F.date_format("Donation_Date", "EEEE"),
    })
    hour = F.col("Hour")
    night_c = F.coalesce(hour.between(*night), F.lit(False))
    first = F.col("Donation_Frequency") == "First-time"
    anon = F.col("Is_Anonymous") == 1
    xfer = F.col("Donation_Type") == "Bank Transfer"
    return df.withColumns({
        "Log_Donation_Amount": F.log1p(amt),
        "Log_Donor_Lifetime_Value": F.log1p(ltv),
        "Donation_Amount_Zscore": (amt - F.lit(a.amt_mean)) / F.lit(a.amt_std_pop),
        "Amt_LTV_Ratio": amt_ltv_ratio(amt, ltv),
        "Is_Night_Donation": night_c.cast("int"),
        "Is_Weekend": F.coalesce(F.weekday("Donation_Date") >= 5, F.lit(False)).cast("int"),
        "Is_Business_Hours": between_flag(hour, *C.BUSINESS_HOURS),
        "Is_Round_Amount": is_round(amt, round_modulus).cast("int"),
        "Near_Threshold": near_threshold(amt).cast("int"),
        "High_Risk_Platform": F.col("Donation_Platform").isin(high_risk).cast("int"),
        "Is_Cold_Acquisition": (F.col("Acquisition_Channel") == "Cold Outreach").cast("int"),
        "Is_Bank_Transfer": xfer.cast("int"),
        "Is_Refund_Type": (F.col("Donation_Type") == "Refund").cast("int"),
        "CVV_Failed": (F.col("CVV_Check") == "Fail").cast("int"),
        "Device_Flagged": (F.col("Device_Fingerprint") == "Known Flagged").cast("int"),
        "Webhook_Chargeback": (F.col("Webhook_Event") == "chargeback.received").cast("int"),
        "Webhook_Reversed": (F.col("Webhook_Event") == "payment.reversed").cast("int"),
        "Is_First_Time_Large": (first & (amt >= F.lit(a.amt_p90))).cast("int"),
        "Is_Anon_Large": (anon & (amt >= F.lit(a.amt_p75))).cast("int"),
        "Is_Corporate_Night": ((F.col("Donor_Segment") == "Corporate") & night_c & xfer).cast("int"),
        "Matched_Anon_Flag": ((F.col("Matched_Giving") == 1) & anon).cast("int"),
        "IP_Mismatch_Large": ((F.col("IP_Country_Match") == 0) & (amt >= F.lit(a.amt_p75))).cast("int"),
        "VPN_Anon_Flag": ((F.col("Is_VPN_Or_Proxy") == 1) & anon).cast("int"),
        "High_Velocity_Flag": (F.col("IP_Velocity_24h") >= 3).cast("int"),
        # scorer-only flags the training table never had
        "Low_Balance_Large_Gift": ((ltv < F.lit(a.ltv_p10)) & (amt >= F.lit(a.amt_p75))).cast("int"),
        "Young_Large": ((F.col("Age") < 25) & (amt >= F.lit(a.amt_p95))).cast("int"),
        "Is_Withdrawal": (F.col("Donation_Type") == "Refund").cast("int"),
        "Is_Transfer": xfer.cast("int"),
    })
