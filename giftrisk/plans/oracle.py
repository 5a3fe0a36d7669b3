"""DuckDB formulation of the batch pipeline, used as the correctness oracle.

It is written independently of the Spark operators (plain SQL, exact window
ranks for quantiles and label flips) over the same input tables, and only
shares the fixed values of ``giftrisk.constants``. ``base_ctes()`` returns the
CTE chain ``bank, base, rq, donations, anchors, features, scored, mm, noisy,
thr, labeled0, flipk, labeled``; every oracle query appends its own SELECT.
"""

from __future__ import annotations

from giftrisk import constants as C
from giftrisk.functions.draws import DRAWS, NOISE_DRAWS, cumulative_bounds


def D(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def u(key: str, salt: str, slot: int) -> str:
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || {s('|' + salt)}), {1 + 8 * slot}, 8))::BIGINT"
            f" AS DOUBLE) / CAST(4294967296 AS DOUBLE))")


def draw(name: str, order_key: str = "Donation_ID", cust_key: str = "Donor_ID") -> str:
    ent, salt, slot = DRAWS[name]
    return u(order_key if ent == "order" else cust_key, salt, slot)


def case_map(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {s(str(k)) if isinstance(k, str) else k} THEN {s(str(v))}"
                     for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default if default is not None else 'NULL'} END)"


def weighted(u_expr: str, options) -> str:
    bounds = cumulative_bounds(options)
    parts = [f"WHEN {u_expr} < {D(b)} THEN {s(v)}" for v, b in bounds[:-1]]
    return f"(CASE {' '.join(parts)} ELSE {s(bounds[-1][0])} END)"


def buckets(u_expr: str, bs) -> str:
    parts = [f"WHEN {u_expr} < {D(b)} THEN {s(v)}" for v, b in bs[:-1]]
    return f"(CASE {' '.join(parts)} ELSE {s(bs[-1][0])} END)"


def inlist(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def quantile_expr(rel: str, col: str, p: float, alias: str) -> str:
    """Scalar subquery: linear-interpolation quantile v[lo] + (v[hi]-v[lo])*(h-lo)."""
    h = f"((n - 1) * {D(p)})"
    return (f"(SELECT lo_v + (hi_v - lo_v) * fr FROM (SELECT "
            f"max(CASE WHEN rn = floor({h}) THEN v END) AS lo_v, "
            f"max(CASE WHEN rn = ceil({h}) THEN v END) AS hi_v, "
            f"max({h} - floor({h})) AS fr FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, "
            f"count(*) OVER () AS n FROM (SELECT {col} AS v FROM {rel}) WHERE v IS NOT NULL))) AS {alias}")


def customer_name_sql(ck: str) -> str:
    pick = lambda xs, d: f"[{', '.join(s(x) for x in xs)}][CAST(floor({d} * {len(xs)}) AS INTEGER) + 1]"
    return (f"CASE WHEN {u(ck, 'world', 0)} < {D(C.WORLD_NAME_SHARE)} THEN {pick(C.WORLD_NAMES, u(ck, 'world', 1))} ELSE "
            f"{pick(C.FIRST_NAMES, u(ck, 'who', 0))} || ' ' || {pick(C.LAST_NAMES, u(ck, 'who', 1))} END")


def _bank() -> str:
    ck, ok = "o.o_custkey", "o.o_orderkey"
    devices = "[" + ", ".join(s(x) for x in C.BANK_DEVICES) + "]"
    secs = f"CAST(floor({u(ok, 'tx', 0)} * 86400) AS INTEGER)"
    state = case_map("c.c_nationkey", dict(enumerate(C.NATION_STATE)))
    price = "CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) / 5, 2) AS DECIMAL(18,2))"
    return f"""bank AS (
  SELECT CAST({ck} AS VARCHAR) AS Donor_ID,
    {customer_name_sql(ck)} AS Donor_Name,
    CASE WHEN {u(ck, 'who', 3)} < {D(0.5)} THEN 'Male' ELSE 'Female' END AS Gender,
    CAST(18 + floor({u(ck, 'who', 2)} * 53) AS INTEGER) AS Age,
    {state} AS Donor_Region,
    {case_map('c.c_mktsegment', C.MKTSEGMENT_TO_ACCOUNT)} AS Account_Type,
    CAST({ok} AS VARCHAR) AS Donation_ID,
    CAST(o.o_orderdate AS DATE) AS Donation_Date,
    printf('%02d:%02d:%02d', CAST(floor({secs} / 3600) AS INTEGER),
           CAST(floor({secs} / 60) AS INTEGER) % 60, {secs} % 60) AS Donation_Time,
    CASE WHEN {u(ok, 'tx', 2)} < {D(C.ROUND_AMOUNT_SHARE)}
         THEN CAST(greatest(round({price} / {C.ROUND_AMOUNT}), 1) * {C.ROUND_AMOUNT} AS DECIMAL(18,2))
         ELSE {price} END AS Amount_INR,
    {case_map('o.o_orderpriority', C.PRIORITY_TO_TYPE)} AS Type_Raw,
    CAST(round(5000 + CAST(9.5 AS DECIMAL(2,1)) * greatest(CAST(c.c_acctbal AS DECIMAL(18,2)),
         CAST(0 AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS LTV_INR,
    {devices}[CAST(floor({u(ok, 'tx', 1)} * 20) AS INTEGER) + 1] AS Device_Raw
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def _base() -> str:
    cc = f"coalesce({case_map('Donor_Region', C.REGION_MAP)}, {s(C.REGION_DEFAULT)})"
    cur = {k: v[0] for k, v in C.CURRENCY_BY_COUNTRY.items()}
    rate = {k: v[1] for k, v in C.CURRENCY_BY_COUNTRY.items()}
    plat = f"coalesce({case_map('Device_Raw', C.PLATFORM_MAP)}, {s(C.PLATFORM_DEFAULT)})"
    camp = [(cid, w) for cid, _, w in C.CAMPAIGNS]
    lo, hi = C.REGULAR_TENURE
    return f"""geo AS (
  SELECT b.*, string_split({cc}, ', ')[-1] AS Donor_Country, string_split({cc}, ', ')[1] AS Donor_City
  FROM bank b
), cur AS (
  SELECT g.*, coalesce({case_map('Donor_Country', cur)}, {s(C.CURRENCY_DEFAULT[0])}) AS Currency,
    round(Amount_INR * CAST(coalesce({case_map('Donor_Country', rate)}, {s(C.CURRENCY_DEFAULT[1])}) AS DECIMAL(8,4)), 2)
      AS Amount_Dec
  FROM geo g
), base AS (
  SELECT Donor_ID, Donor_Name, Gender, Age, Donor_City, Donor_Country,
    {case_map('Account_Type', C.SEGMENT_MAP)} AS Segment0,
    CAST(Amount_Dec AS DOUBLE) AS Donation_Amount,
    CAST(round(LTV_INR * CAST({case_map('Currency', C.RATE_BY_CURRENCY)} AS DECIMAL(8,4)), 2) AS DOUBLE)
      AS Donor_Lifetime_Value,
    Donation_ID, Donation_Date, Donation_Time, Currency,
    {case_map('Type_Raw', C.DONATION_TYPE_MAP)} AS Donation_Type,
    {plat} AS Donation_Platform,
    coalesce({case_map(plat, C.PROCESSOR_BY_PLATFORM)}, {s(C.PROCESSOR_DEFAULT)}) AS Payment_Processor,
    {weighted(draw('campaign'), camp)} AS Campaign_ID,
    {weighted(draw('frequency'), C.FREQUENCIES)} AS Donation_Frequency,
    {weighted(draw('channel'), C.CHANNELS)} AS Acquisition_Channel
  FROM cur
), base2 AS (
  SELECT b.*,
    {case_map('Campaign_ID', {cid: name for cid, name, _ in C.CAMPAIGNS})} AS Campaign_Name,
    CAST(CASE WHEN Donation_Frequency = 'First-time' THEN 0
         WHEN Donation_Frequency = 'Regular' THEN {lo} + floor({draw('tenure_regular')} * {hi - lo})
         ELSE least(greatest(floor(CAST(-{C.TENURE_SCALE} AS DOUBLE) * ln(1 - {draw('tenure')})), 0), {C.TENURE_MAX})
         END AS INTEGER) AS Donor_Since_Days,
    CAST((Donor_Country = 'UK' AND {draw('gift_aid')} < {D(C.GIFT_AID_UK)}) AS INTEGER) AS Gift_Aid_Eligible,
    CAST({draw('recurring')} < (CASE Donation_Frequency {' '.join(f"WHEN {s(k)} THEN {D(v)}" for k, v in C.RECURRING_PROB.items())} END) AS INTEGER) AS Is_Recurring,
    CASE WHEN Donation_Platform NOT IN {inlist(C.CARD_PLATFORMS)} THEN 'N/A'
         WHEN {draw('cvv')} < {D(C.CVV_PASS)} THEN 'Pass' ELSE 'Fail' END AS CVV_Check,
    {buckets(draw('fingerprint'), C.DEVICE_BUCKETS)} AS Device_Fingerprint,
    {buckets(draw('webhook'), C.WEBHOOK_BUCKETS)} AS Webhook_Event
  FROM base b
)"""


def _donations() -> str:
    p_reg, lo_reg, hi_reg = C.VELOCITY_REGULAR
    p_corp, lo_corp, hi_corp = C.VELOCITY_CORPORATE
    p_amb, v_amb = C.VELOCITY_AMBIENT
    card_vals = cumulative_bounds(C.VELOCITY_CARD_VALUES)
    card_case = ("CASE " + " ".join(f"WHEN {draw('vel_card_value')} < {D(b)} THEN {v}" for v, b in card_vals[:-1])
                 + f" ELSE {card_vals[-1][0]} END")
    cols = ", ".join(C.DONATION_COLUMNS)
    return f"""rq AS (
  SELECT {quantile_expr('base2', 'Donation_Amount', 0.90, 'rp90')}, {quantile_expr('base2', 'Donation_Amount', 0.95, 'rp95')}
), seg AS (
  SELECT b.*, CASE WHEN Donation_Amount > rq.rp95 AND {draw('major')} < {D(C.MAJOR_DONOR_DRAW)}
         THEN 'Major Donor' ELSE Segment0 END AS Donor_Segment,
    CAST(({draw('anon_base')} < {D(C.ANON_BASE)})
      OR (Donation_Amount > rq.rp90 AND {draw('anon_highval')} < {D(C.ANON_HIGHVAL)})
      OR (Donation_Platform IN {inlist(C.ANON_PLATFORMS)} AND {draw('anon_platform')} < {D(C.ANON_PLATFORM)}) AS INTEGER)
      AS Is_Anonymous,
    CAST(({draw('refund_base')} < {D(C.REFUND_BASE)})
      OR (Donation_Amount > rq.rp90 AND {draw('refund_highval')} < {D(C.REFUND_HIGHVAL)})
      OR (Donation_Platform IN {inlist(C.REFUND_PLATFORMS)} AND {draw('refund_platform')} < {D(C.REFUND_PLATFORM)}) AS INTEGER)
      AS Refund_Requested
  FROM base2 b, rq
), ipm AS (
  SELECT g.*,
    CAST(({draw('matched_base')} < {D(C.MATCHED_BASE)})
      OR (Donor_Segment = 'Corporate' AND {draw('matched_corporate')} < {D(C.MATCHED_CORPORATE)})
      OR (Campaign_ID = {s(C.MATCHED_CAMPAIGN)} AND {draw('matched_december')} < {D(C.MATCHED_DECEMBER)}) AS INTEGER)
      AS Matched_Giving,
    {draw('mismatch')} < least({D(C.MISMATCH_BASE)}
      + (CASE WHEN Is_Anonymous = 1 THEN {D(C.MISMATCH_ANON)} ELSE {D(0)} END)
      + (CASE WHEN Donation_Platform IN {inlist(C.MISMATCH_PLATFORMS)} THEN {D(C.MISMATCH_PLATFORM)} ELSE {D(0)} END)
      + (CASE WHEN Donation_Frequency = 'First-time' THEN {D(C.MISMATCH_FIRST)} ELSE {D(0)} END)
      + (CASE WHEN Donor_Country IN {inlist(C.GULF_COUNTRIES)} THEN {D(C.MISMATCH_GULF)} ELSE {D(0)} END),
      {D(C.MISMATCH_CAP)}) AS mism
  FROM seg g
), vpn AS (
  SELECT i.*, {draw('vpn')} < least({D(C.VPN_BASE)}
      + (CASE WHEN mism THEN {D(C.VPN_MISMATCH)} ELSE {D(0)} END)
      + (CASE WHEN Is_Anonymous = 1 THEN {D(C.VPN_ANON)} ELSE {D(0)} END)
      + (CASE WHEN Donation_Platform IN {inlist(C.VPN_PLATFORMS)} THEN {D(C.VPN_PLATFORM)} ELSE {D(0)} END),
      {D(C.VPN_CAP)}) AS vpn
  FROM ipm i
), vel AS (
  SELECT v.*,
    CASE WHEN mism OR (vpn AND {draw('vpn_mismatch')} < {D(C.VPN_FORCES_MISMATCH)}) THEN 0 ELSE 1 END AS IP_Country_Match,
    CAST(vpn AS INTEGER) AS Is_VPN_Or_Proxy,
    (Donation_Frequency = 'Regular' AND {draw('vel_regular')} < {D(p_reg)}) AS multi,
    (Donor_Segment = 'Corporate' AND {draw('vel_corporate')} < {D(p_corp)}) AS corp
  FROM vpn v
), donations AS (
  SELECT {cols.replace('IP_Velocity_24h', '')}
    CAST(CASE WHEN {draw('vel_card')} < {D(C.VELOCITY_CARD_TESTING)} THEN {card_case}
         WHEN {draw('vel_ambient')} < {D(p_amb)} AND NOT multi AND NOT corp THEN {v_amb}
         WHEN corp THEN {lo_corp} + floor({draw('vel_corporate_value')} * {hi_corp - lo_corp})
         WHEN multi THEN {lo_reg} + floor({draw('vel_regular_value')} * {hi_reg - lo_reg})
         ELSE 1 END AS INTEGER) AS IP_Velocity_24h
  FROM vel
)"""


def _anchors() -> str:
    ratio = "Donation_Amount / (Donor_Lifetime_Value + 1)"
    return f"""anchors AS (
  SELECT (SELECT count(*) FROM donations) AS n,
    (SELECT avg(Donation_Amount) FROM donations) AS amt_mean,
    (SELECT stddev_pop(Donation_Amount) FROM donations) AS amt_std_pop,
    (SELECT stddev_samp(Donation_Amount) FROM donations) AS amt_std_samp,
    {quantile_expr('donations', 'Donation_Amount', 0.75, 'amt_p75')},
    {quantile_expr('donations', 'Donation_Amount', 0.90, 'amt_p90')},
    {quantile_expr('donations', 'Donation_Amount', 0.95, 'amt_p95')},
    {quantile_expr('donations', 'Donor_Lifetime_Value', 0.10, 'ltv_p10')},
    {quantile_expr('donations', ratio, 0.90, 'ratio_p90')}
)"""


def near_sql(col: str = "Donation_Amount", thresholds=C.STRUCTURING_THRESHOLDS) -> str:
    return "(" + " OR ".join(f"({col} >= {D(t * C.NEAR_THRESHOLD_BAND)} AND {col} < {D(t)})"
                             for t in thresholds) + ")"


def _features() -> str:
    night = "coalesce(Hour BETWEEN 0 AND 4, false)"
    return f"""features AS (
  SELECT d.*, Hour, dayname(Donation_Date) AS DayOfWeek,
    ln(1 + Donation_Amount) AS Log_Donation_Amount,
    ln(1 + Donor_Lifetime_Value) AS Log_Donor_Lifetime_Value,
    (Donation_Amount - a.amt_mean) / a.amt_std_pop AS Donation_Amount_Zscore,
    CASE WHEN Donor_Lifetime_Value + 1 = 0 THEN NULL ELSE Donation_Amount / (Donor_Lifetime_Value + 1) END AS Amt_LTV_Ratio,
    CAST({night} AS INTEGER) AS Is_Night_Donation,
    CAST(coalesce(isodow(Donation_Date) >= 6, false) AS INTEGER) AS Is_Weekend,
    CAST(coalesce(Hour BETWEEN 9 AND 17, false) AS INTEGER) AS Is_Business_Hours,
    CAST(Donation_Amount % 50 = 0 AS INTEGER) AS Is_Round_Amount,
    CAST({near_sql()} AS INTEGER) AS Near_Threshold,
    CAST(Donation_Platform IN {inlist(C.HIGH_RISK_PLATFORMS_FEATURE)} AS INTEGER) AS High_Risk_Platform,
    CAST(Acquisition_Channel = 'Cold Outreach' AS INTEGER) AS Is_Cold_Acquisition,
    CAST(Donation_Type = 'Bank Transfer' AS INTEGER) AS Is_Bank_Transfer,
    CAST(Donation_Type = 'Refund' AS INTEGER) AS Is_Refund_Type,
    CAST(CVV_Check = 'Fail' AS INTEGER) AS CVV_Failed,
    CAST(Device_Fingerprint = 'Known Flagged' AS INTEGER) AS Device_Flagged,
    CAST(Webhook_Event = 'chargeback.received' AS INTEGER) AS Webhook_Chargeback,
    CAST(Webhook_Event = 'payment.reversed' AS INTEGER) AS Webhook_Reversed,
    CAST(Donation_Frequency = 'First-time' AND Donation_Amount >= a.amt_p90 AS INTEGER) AS Is_First_Time_Large,
    CAST(Is_Anonymous = 1 AND Donation_Amount >= a.amt_p75 AS INTEGER) AS Is_Anon_Large,
    CAST(Donor_Segment = 'Corporate' AND {night} AND Donation_Type = 'Bank Transfer' AS INTEGER) AS Is_Corporate_Night,
    CAST(Matched_Giving = 1 AND Is_Anonymous = 1 AS INTEGER) AS Matched_Anon_Flag,
    CAST(IP_Country_Match = 0 AND Donation_Amount >= a.amt_p75 AS INTEGER) AS IP_Mismatch_Large,
    CAST(Is_VPN_Or_Proxy = 1 AND Is_Anonymous = 1 AS INTEGER) AS VPN_Anon_Flag,
    CAST(IP_Velocity_24h >= 3 AS INTEGER) AS High_Velocity_Flag,
    CAST(Donor_Lifetime_Value < a.ltv_p10 AND Donation_Amount >= a.amt_p75 AS INTEGER) AS Low_Balance_Large_Gift,
    CAST(Age < 25 AND Donation_Amount >= a.amt_p95 AS INTEGER) AS Young_Large,
    CAST(Donation_Type = 'Refund' AS INTEGER) AS Is_Withdrawal,
    CAST(Donation_Type = 'Bank Transfer' AS INTEGER) AS Is_Transfer
  FROM (SELECT *, CAST(hour(try_strptime(Donation_Time, '%H:%M:%S')) AS INTEGER) AS Hour FROM donations) d, anchors a
)"""


# SQL predicates of the rule terms, written over the `features` relation with
# anchors `a`; term ids and weights as in giftrisk.operators.rules.TERMS.
def _term_sql() -> list[tuple[str, str, int, str]]:
    L = "Donation_Amount >= a.amt_p75"
    P90 = "Donation_Amount >= a.amt_p90"
    P95 = "Donation_Amount >= a.amt_p95"
    anon, first, refund = "Is_Anonymous = 1", "Donation_Frequency = 'First-time'", "Refund_Requested = 1"
    cvv, flagged = "CVV_Check = 'Fail'", "Device_Fingerprint = 'Known Flagged'"
    hi = f"Donation_Platform IN {inlist(C.HIGH_RISK_PLATFORMS_RULE)}"
    night, xfer = "coalesce(Hour BETWEEN 0 AND 4, false)", "Donation_Type = 'Bank Transfer'"
    rnd, emg = "Donation_Amount % 50 = 0", f"Campaign_ID = {s(C.EMERGENCY_CAMPAIGN)}"
    cold, corp, matched = "Acquisition_Channel = 'Cold Outreach'", "Donor_Segment = 'Corporate'", "Matched_Giving = 1"
    wkend = "coalesce(isodow(Donation_Date) >= 6, false)"
    mism, vpn, v3, v5 = "IP_Country_Match = 0", "Is_VPN_Or_Proxy = 1", "IP_Velocity_24h >= 3", "IP_Velocity_24h >= 5"
    ratio = "coalesce(Amt_LTV_Ratio > a.ratio_p90, false)"
    ratio2 = "coalesce(Amt_LTV_Ratio > a.ratio_p90 * 2, false)"

    def a(*xs):
        return "(" + " AND ".join(f"({x})" for x in xs) + ")"

    def near(t):
        return f"(Donation_Amount >= {D(t * C.NEAR_THRESHOLD_BAND)} AND Donation_Amount < {D(t)})"
    return [
        ("R1", "refund", 30, refund), ("R1", "refund_large", 15, a(refund, L)),
        ("R2", "anon_large", 22, a(anon, L)), ("R2", "anon_p95", 15, a(anon, P95)),
        ("R3", "first_p90", 20, a(first, P90)),
        ("R3", "first_new_large", 12, a(first, "Donor_Since_Days = 0", L)),
        ("R4", "cvv_fail", 28, cvv), ("R4", "cvv_fail_large", 10, a(cvv, L)),
        ("R5", "device_flagged", 30, flagged), ("R5", "device_flagged_large", 12, a(flagged, L)),
        ("R6", "chargeback", 35, "Webhook_Event = 'chargeback.received'"),
        ("R6", "reversed", 20, "Webhook_Event = 'payment.reversed'"),
        ("R6", "reversed_large", 15, a("Webhook_Event = 'payment.reversed'", L)),
        ("R7", "high_risk_platform", 8, hi), ("R7", "high_risk_platform_large", 16, a(hi, L)),
        ("R8", "ratio_p90", 18, ratio), ("R8", "ratio_2p90", 12, ratio2),
        ("R8", "low_ltv_large", 20, a("Donor_Lifetime_Value < a.ltv_p10", L)),
        ("R9", "night_transfer_large", 22, a(night, xfer, L)), ("R9", "night_large", 6, a(night, L)),
        ("R10", "round_p90", 15, a(rnd, P90)), ("R10", "round_p95", 10, a(rnd, P95)),
        ("R11", "emergency_anon_large", 12, a(emg, anon, L)),
        ("R11", "emergency_first_p90", 8, a(emg, first, P90)),
        ("R12", "cold_large_first", 18, a(cold, L, first)), ("R12", "cold_p95", 12, a(cold, P95)),
        ("R13", "corporate_night_transfer_large", 20, a(corp, night, xfer, L)),
        ("R14", "matched_anon", 15, a(matched, anon)), ("R14", "matched_first_p90", 10, a(matched, first, P90)),
        ("R15", "near_500", 12, near(500)), ("R15", "near_750", 12, near(750)),
        ("R15", "near_900", 12, near(900)), ("R15", "near_950", 12, near(950)),
        ("R16", "weekend_night_first_large", 18, a(wkend, night, first, L)),
        ("R17", "ip_mismatch", 12, mism), ("R17", "ip_mismatch_large", 10, a(mism, L)),
        ("R17", "ip_mismatch_first_large", 15, a(mism, first, L)), ("R17", "ip_mismatch_refund", 18, a(mism, refund)),
        ("R18", "vpn", 10, vpn), ("R18", "vpn_large", 12, a(vpn, L)), ("R18", "vpn_anon", 15, a(vpn, anon)),
        ("R18", "vpn_cvv_fail", 20, a(vpn, cvv)), ("R18", "vpn_mismatch", 10, a(vpn, mism)),
        ("R19", "velocity_3", 15, v3), ("R19", "velocity_5", 20, v5),
        ("R19", "velocity_5_cvv_fail", 15, a(v5, cvv)), ("R19", "velocity_3_large", 12, a(v3, L)),
        ("R20", "flags_3", 20, "Flag_Count >= 3"), ("R20", "flags_4", 15, "Flag_Count >= 4"),
    ]


FLAG_SQL = ["Refund_Requested = 1", "Is_Anonymous = 1", "Donation_Frequency = 'First-time'",
            "CVV_Check = 'Fail'", "Device_Fingerprint = 'Known Flagged'",
            f"Donation_Platform IN {inlist(C.HIGH_RISK_PLATFORMS_RULE)}",
            "coalesce(Hour BETWEEN 0 AND 4, false)", "Acquisition_Channel = 'Cold Outreach'",
            "IP_Country_Match = 0", "Is_VPN_Or_Proxy = 1", "IP_Velocity_24h >= 3"]


def _scored() -> str:
    terms = _term_sql()
    rules = []
    for r in [f"R{i}" for i in range(1, 21)]:
        parts = [f"(CASE WHEN {p} THEN {w} ELSE 0 END)" for rr, _, w, p in terms if rr == r]
        rules.append(f"{' + '.join(parts)} AS {r}_10")
    fired = ", ".join(f"CASE WHEN {p} THEN {s(t)} END" for _, t, _, p in terms)
    flags = " + ".join(f"CAST(({f}) AS INTEGER)" for f in FLAG_SQL)
    total = " + ".join(f"R{i}_10" for i in range(1, 21))
    return f"""flagged AS (
  SELECT f.*, {flags} AS Flag_Count FROM features f
), ruled AS (
  SELECT f.*, {', '.join(rules)},
    list_filter([{fired}], lambda x: x IS NOT NULL) AS Fired_Terms
  FROM flagged f, anchors a
), scored AS (
  SELECT r.*, {total} AS Rule_Score_10, ({total}) / CAST(10 AS DOUBLE) AS Rule_Score FROM ruled r
)"""


def _labeled() -> str:
    noise_terms = " + ".join(u("Donation_ID", f"{salt}", slot) for _, salt, slot in NOISE_DRAWS)
    p = 1 - C.TARGET_ANOMALY_RATE
    return f"""mm AS (
  SELECT min(Rule_Score) AS mn, max(Rule_Score) AS mx FROM scored
), normed AS (
  SELECT s.*, (Rule_Score - mm.mn) / (mm.mx - mm.mn + {D(1e-9)}) AS Score_Norm FROM scored s, mm
), noisy AS (
  SELECT n.*, least(greatest(Score_Norm + {D(C.NOISE_SD)} * (({noise_terms}) - {D(6.0)}), {D(0.0)}), {D(1.0)})
    AS Score_Noisy FROM normed n
), thr AS (
  SELECT {quantile_expr('noisy', 'Score_Noisy', p, 't')}
), labeled0 AS (
  SELECT n.*, CAST(Score_Noisy >= thr.t AS INTEGER) AS Label_Raw,
    ('0x' || substr(md5(Donation_ID || '|flip'), 1, 15))::BIGINT AS flipdraw
  FROM noisy n, thr
), flipk AS (
  SELECT CAST(floor(count_if(Label_Raw = 1) * {D(C.MISS_RATE)}) AS BIGINT) AS k1,
         CAST(floor(count_if(Label_Raw = 0) * {D(C.FALSE_FLAG_RATE)}) AS BIGINT) AS k0 FROM labeled0
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY Label_Raw ORDER BY flipdraw, Donation_ID) AS flip_rank
  FROM labeled0 l
), labeled AS (
  SELECT r.* EXCLUDE (flipdraw, flip_rank),
    CAST((Label_Raw = 1 AND flip_rank <= k1) OR (Label_Raw = 0 AND flip_rank <= k0) AS INTEGER) AS Label_Flipped,
    CASE WHEN (Label_Raw = 1 AND flip_rank <= k1) OR (Label_Raw = 0 AND flip_rank <= k0)
         THEN 1 - Label_Raw ELSE Label_Raw END AS Is_Anomalous
  FROM ranked r, flipk
)"""


def base_ctes() -> str:
    return "WITH " + ",\n".join([_bank(), _base(), _donations(), _anchors(), _features(), _scored(),
                                 _labeled()])


def with_base(select: str) -> str:
    return base_ctes() + "\n" + select
