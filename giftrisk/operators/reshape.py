"""Bank transactions -> donation table (drop, rename, dictionary maps,
currency conversion and the key-derived enrichment columns).

Two anchors (p90 and p95 of the donation amount) are needed half way; they are
computed once with the exact distributed quantile and passed in as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.functions.draws import cumulative_bounds, draw_of_pairs, hash_columns, pair_columns, weighted_choice
from giftrisk.operators.quantiles import exact_quantiles
from giftrisk.sources.bank import literal_map


def _draws(df: DataFrame) -> DataFrame:
    """Adds the draws as numbers, two in a long; the hashes they are read from go no
    further, as every step after would copy them."""
    keys = {"order": F.col("Donation_ID"), "cust": F.col("Donor_ID")}
    hashes = hash_columns(keys)
    return df.withColumns(hashes).withColumns(pair_columns()).drop(*hashes)


def _u(name: str) -> Column:
    return draw_of_pairs(name)


def _drop_draws(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_u_")])


def convert_currency(amount_inr: Column, rate: Column) -> Column:
    """round(amount * rate, 2) in decimal arithmetic (HALF_UP, exact)."""
    return F.round(amount_inr.cast("decimal(18,2)") * rate.cast("decimal(8,4)"), 2).cast("decimal(18,2)")


def remap_base(bank: DataFrame) -> DataFrame:
    """Deterministic part of the reshape: everything that does not need amount
    anchors."""
    df = bank.drop(*C.BANK_DROP_COLUMNS).withColumnsRenamed(C.BANK_RENAME)
    # geography: "City, State" -> state -> "City, Country" (default London)
    region_raw = F.substring_index(F.col("Donation_Location"), ", ", -1)
    place = {k: v.split(", ") for k, v in C.REGION_MAP.items()}
    default = C.REGION_DEFAULT.split(", ")
    df = df.withColumns({
        "Donor_Country": F.coalesce(literal_map({k: v[-1] for k, v in place.items()})[region_raw], F.lit(default[-1])),
        "Donor_City": F.coalesce(literal_map({k: v[0] for k, v in place.items()})[region_raw], F.lit(default[0])),
    }).drop("Donation_Location", "Donor_Region")
    # currency by country (multi-column map with default)
    cur = literal_map({k: v[0] for k, v in C.CURRENCY_BY_COUNTRY.items()})[F.col("Donor_Country")]
    rate = literal_map({k: v[1] for k, v in C.CURRENCY_BY_COUNTRY.items()})[F.col("Donor_Country")]
    df = df.withColumns({
        "Currency": F.coalesce(cur, F.lit(C.CURRENCY_DEFAULT[0])),
        "_rate": F.coalesce(rate, F.lit(C.CURRENCY_DEFAULT[1])),
    })
    df = _draws(df)
    amount = convert_currency(F.col("Donation_Amount_INR"), F.col("_rate"))
    ltv_rate = literal_map(C.RATE_BY_CURRENCY)[F.col("Currency")]
    df = df.withColumns({
        "Donation_Amount": amount.cast("double"),
        "Donor_Lifetime_Value": convert_currency(F.col("Donor_Lifetime_Value_INR"), ltv_rate).cast("double"),
    }).drop("Donation_Amount_INR", "Donor_Lifetime_Value_INR", "_rate")
    # dictionary remaps
    platform = F.coalesce(literal_map(C.PLATFORM_MAP)[F.col("Device_Raw")], F.lit(C.PLATFORM_DEFAULT))
    df = df.withColumns({
        "Donor_Segment": literal_map(C.SEGMENT_MAP)[F.col("Donor_Segment")],
        "Donation_Type": literal_map(C.DONATION_TYPE_MAP)[F.col("Donation_Type_Raw")],
        "Donation_Platform": platform,
    }).drop("Donation_Type_Raw", "Device_Raw", "Device_Category")
    df = df.withColumn("Payment_Processor", F.coalesce(
        literal_map(C.PROCESSOR_BY_PLATFORM)[F.col("Donation_Platform")], F.lit(C.PROCESSOR_DEFAULT)))
    # campaign, frequency, channel: weighted categorical draws
    camp_ids = [(cid, w) for cid, _, w in C.CAMPAIGNS]
    camp_name = literal_map({cid: name for cid, name, _ in C.CAMPAIGNS})
    df = df.withColumn("Campaign_ID", weighted_choice(_u("campaign"), camp_ids))
    df = df.withColumns({
        "Campaign_Name": camp_name[F.col("Campaign_ID")],
        "Donation_Frequency": weighted_choice(_u("frequency"), C.FREQUENCIES),
        "Acquisition_Channel": weighted_choice(_u("channel"), C.CHANNELS),
    })
    freq = F.col("Donation_Frequency")
    expo = F.least(F.greatest(F.floor(-C.TENURE_SCALE * F.ln(1 - _u("tenure"))), F.lit(0)),
                   F.lit(C.TENURE_MAX))
    lo, hi = C.REGULAR_TENURE
    tenure = (F.when(freq == "First-time", 0)
              .when(freq == "Regular", lo + F.floor(_u("tenure_regular") * (hi - lo)))
              .otherwise(expo)).cast("int")
    recurring_p = literal_map(C.RECURRING_PROB)[freq]
    card = F.col("Donation_Platform").isin(C.CARD_PLATFORMS)
    df = df.withColumns({
        "Donor_Since_Days": tenure,
        "Gift_Aid_Eligible": ((F.col("Donor_Country") == "UK") & (_u("gift_aid") < C.GIFT_AID_UK)).cast("int"),
        "Is_Recurring": (_u("recurring") < recurring_p).cast("int"),
        "CVV_Check": F.when(~card, "N/A").when(_u("cvv") < C.CVV_PASS, "Pass").otherwise("Fail"),
        "Device_Fingerprint": weighted_bucket(_u("fingerprint"), C.DEVICE_BUCKETS),
        "Webhook_Event": weighted_bucket(_u("webhook"), C.WEBHOOK_BUCKETS),
    })
    return df


def weighted_bucket(u: Column, buckets: list[tuple[str, float]]) -> Column:
    """Chained thresholds on one draw: first bucket whose bound exceeds u."""
    expr = None
    for i, (value, bound) in enumerate(buckets):
        if i == len(buckets) - 1:
            return expr.otherwise(F.lit(value))
        cond = u < F.lit(bound)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def amount_anchors(base: DataFrame) -> dict[str, float]:
    amt = F.col("Donation_Amount")
    return exact_quantiles(base, {"amt_p90": (amt, 0.90), "amt_p95": (amt, 0.95)})


def enrich(base: DataFrame, amt_p90: float, amt_p95: float) -> DataFrame:
    """Anchor-dependent draws: Major Donor, anonymity, refunds, matched giving,
    IP mismatch, VPN and IP velocity."""
    amt = F.col("Donation_Amount")
    plat = F.col("Donation_Platform")
    df = base.withColumn("Donor_Segment", F.when(
        (amt > F.lit(amt_p95)) & (_u("major") < C.MAJOR_DONOR_DRAW), F.lit("Major Donor"))
        .otherwise(F.col("Donor_Segment")))
    anon = ((_u("anon_base") < C.ANON_BASE)
            | ((amt > F.lit(amt_p90)) & (_u("anon_highval") < C.ANON_HIGHVAL))
            | (plat.isin(C.ANON_PLATFORMS) & (_u("anon_platform") < C.ANON_PLATFORM)))
    refund = ((_u("refund_base") < C.REFUND_BASE)
              | ((amt > F.lit(amt_p90)) & (_u("refund_highval") < C.REFUND_HIGHVAL))
              | (plat.isin(C.REFUND_PLATFORMS) & (_u("refund_platform") < C.REFUND_PLATFORM)))
    matched = ((_u("matched_base") < C.MATCHED_BASE)
               | ((F.col("Donor_Segment") == "Corporate") & (_u("matched_corporate") < C.MATCHED_CORPORATE))
               | ((F.col("Campaign_ID") == C.MATCHED_CAMPAIGN) & (_u("matched_december") < C.MATCHED_DECEMBER)))
    df = df.withColumns({
        "Is_Anonymous": anon.cast("int"),
        "Refund_Requested": refund.cast("int"),
        "Matched_Giving": matched.cast("int"),
    })
    is_anon = F.col("Is_Anonymous") == 1
    p_mis = (F.lit(C.MISMATCH_BASE)
             + F.when(is_anon, C.MISMATCH_ANON).otherwise(0.0)
             + F.when(plat.isin(C.MISMATCH_PLATFORMS), C.MISMATCH_PLATFORM).otherwise(0.0)
             + F.when(F.col("Donation_Frequency") == "First-time", C.MISMATCH_FIRST).otherwise(0.0)
             + F.when(F.col("Donor_Country").isin(C.GULF_COUNTRIES), C.MISMATCH_GULF).otherwise(0.0))
    mismatch = _u("mismatch") < F.least(p_mis, F.lit(C.MISMATCH_CAP))
    p_vpn = (F.lit(C.VPN_BASE)
             + F.when(mismatch, C.VPN_MISMATCH).otherwise(0.0)
             + F.when(is_anon, C.VPN_ANON).otherwise(0.0)
             + F.when(plat.isin(C.VPN_PLATFORMS), C.VPN_PLATFORM).otherwise(0.0))
    vpn = _u("vpn") < F.least(p_vpn, F.lit(C.VPN_CAP))
    forced = vpn & (_u("vpn_mismatch") < C.VPN_FORCES_MISMATCH)
    df = df.withColumns({
        "IP_Country_Match": F.when(mismatch | forced, 0).otherwise(1),
        "Is_VPN_Or_Proxy": vpn.cast("int"),
    })
    # velocity layers, later layer wins
    p_reg, lo_reg, hi_reg = C.VELOCITY_REGULAR
    p_corp, lo_corp, hi_corp = C.VELOCITY_CORPORATE
    p_amb, v_amb = C.VELOCITY_AMBIENT
    multi = (F.col("Donation_Frequency") == "Regular") & (_u("vel_regular") < p_reg)
    corp = (F.col("Donor_Segment") == "Corporate") & (_u("vel_corporate") < p_corp)
    ambient = (_u("vel_ambient") < p_amb) & ~multi & ~corp
    cardtest = _u("vel_card") < C.VELOCITY_CARD_TESTING
    card_value = None
    for i, (v, bound) in enumerate(cumulative_bounds(C.VELOCITY_CARD_VALUES)):
        cond = _u("vel_card_value") < F.lit(bound)
        if i == len(C.VELOCITY_CARD_VALUES) - 1:
            card_value = card_value.otherwise(F.lit(v))
        else:
            card_value = F.when(cond, F.lit(v)) if card_value is None else card_value.when(cond, F.lit(v))
    velocity = (F.when(cardtest, card_value)
                .when(ambient, F.lit(v_amb))
                .when(corp, lo_corp + F.floor(_u("vel_corporate_value") * (hi_corp - lo_corp)))
                .when(multi, lo_reg + F.floor(_u("vel_regular_value") * (hi_reg - lo_reg)))
                .otherwise(F.lit(1))).cast("int")
    df = df.withColumn("IP_Velocity_24h", velocity)
    fraud = [c for c in df.columns if c == "Is_Fraud"]  # a bank's own label, if its rows have one
    return _drop_draws(df).select(*C.DONATION_COLUMNS, *fraud)


def donations(bank: DataFrame) -> DataFrame:
    """Full reshape: bank transactions -> 32-column donation table, 33 with the bank's
    Is_Fraud."""
    base = remap_base(bank)
    a = amount_anchors(base)
    return enrich(base, a["amt_p90"], a["amt_p95"])
