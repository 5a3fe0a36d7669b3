"""Event-time windows and interval joins (W4, W9, W10, J9, J10, J11, T3 batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftrisk.operators import windows as WN
from giftrisk.plans.oracle import with_base
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.registry import q6, query, r6
from giftrisk.sources.events import payment_events, refunds

P = Pipeline.get
HOUR_US = 3_600 * 1_000_000
DAY_US = 24 * HOUR_US

EVENTS_SQL = ("SELECT event_id, epoch_us(ts) AS t_us, user_id AS donor_id, json_extract_string(props, '$.k') AS ip_key, "
              "CASE event_type WHEN 'purchase' THEN 'payment.authorised' WHEN 'error' THEN 'payment.declined' "
              "WHEN 'view' THEN 'payment.reversed' WHEN 'signup' THEN 'chargeback.received' "
              "WHEN 'click' THEN 'donation.attempt' END AS webhook_event, value AS amount FROM events")


@query("ip_velocity_24h", f"WITH ev AS ({EVENTS_SQL}) SELECT event_id, ip_key, count(*) OVER (PARTITION BY ip_key "
       f"ORDER BY t_us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS velocity_24h FROM ev")
def ip_velocity_24h(spark, sf_dir):
    """Events per IP key in the trailing 24 h."""
    ev = payment_events(spark, sf_dir)
    out = WN.range_sums(ev, ["ip_key"], "t_us", DAY_US, {"velocity_24h": F.lit(1)})
    return out.select("event_id", "ip_key", "velocity_24h")


@query("card_testing_burst", f"WITH ev AS ({EVENTS_SQL}), d AS (SELECT *, count(*) OVER (PARTITION BY donor_id "
       f"ORDER BY t_us RANGE BETWEEN {6 * HOUR_US} PRECEDING AND CURRENT ROW) AS n_declines_6h FROM ev "
       "WHERE webhook_event = 'payment.declined') SELECT event_id, donor_id, n_declines_6h FROM d WHERE n_declines_6h >= 3")
def card_testing_burst(spark, sf_dir):
    """T3 batch twin: >= 3 declined payments by one donor within 6 h."""
    ev = payment_events(spark, sf_dir).where(F.col("webhook_event") == "payment.declined")
    out = WN.range_sums(ev, ["donor_id"], "t_us", 6 * HOUR_US, {"n_declines_6h": F.lit(1)})
    return out.where(F.col("n_declines_6h") >= 3).select("event_id", "donor_id", "n_declines_6h")


REVERSAL_SQL = (f"WITH ev AS ({EVENTS_SQL}), x AS (SELECT *, min(CASE WHEN webhook_event = "
       f"'payment.reversed' THEN t_us END) OVER (PARTITION BY donor_id ORDER BY t_us RANGE BETWEEN CURRENT ROW AND "
       f"{HOUR_US} FOLLOWING) AS rev_us FROM ev WHERE webhook_event IN ('payment.authorised', 'payment.reversed')) "
       "SELECT event_id AS auth_event_id, donor_id, rev_us - t_us AS micros_to_reversal FROM x "
       "WHERE webhook_event = 'payment.authorised' AND rev_us IS NOT NULL")


@query("reversal_interval_join", REVERSAL_SQL)
def reversal_interval_join(spark, sf_dir):
    """Each authorised payment with the first reversal by the same donor
    within 1 h (as-of form of the interval join: one row per authorisation,
    never all pairs)."""
    ev = payment_events(spark, sf_dir).where(F.col("webhook_event").isin("payment.authorised", "payment.reversed"))
    out = WN.next_event(ev, ["donor_id"], "t_us", F.col("webhook_event") == "payment.reversed", "rev_us")
    return (out.where((F.col("webhook_event") == "payment.authorised") & (F.col("rev_us") <= F.col("t_us") + HOUR_US))
            .select(F.col("event_id").alias("auth_event_id"), "donor_id",
                    (F.col("rev_us") - F.col("t_us")).alias("micros_to_reversal")))


def _donation_ts_sql():
    return "CAST(Donation_Date AS TIMESTAMP) + CAST(Donation_Time AS INTERVAL)"


@query("refund_interval_join", lambda: with_base(
    f"SELECT d.Donation_ID, r.l_linenumber, epoch_us(CAST(r.l_shipdate AS TIMESTAMP)) - epoch_us({_donation_ts_sql()}) "
    "AS micros_after FROM donations d JOIN lineitem r ON d.Donation_ID = CAST(r.l_orderkey AS VARCHAR) "
    f"WHERE r.l_returnflag = 'R' AND CAST(r.l_shipdate AS TIMESTAMP) BETWEEN {_donation_ts_sql()} AND "
    f"{_donation_ts_sql()} + INTERVAL 30 DAY"))
def refund_interval_join(spark, sf_dir):
    """Refund requests within 30 days after the donation (equi key + time
    range; the key is unique on the donation side, so no pair blow-up)."""
    d = P(spark, sf_dir).donations()
    ts = F.to_timestamp(F.concat_ws(" ", F.date_format("Donation_Date", "yyyy-MM-dd"), F.col("Donation_Time")))
    d = d.select("Donation_ID", ts.alias("donation_ts"))
    r = refunds(spark, sf_dir)
    j = d.join(r, "Donation_ID").where(
        F.col("refund_ts").between(F.col("donation_ts"), F.col("donation_ts") + F.expr("INTERVAL 30 DAYS")))
    return j.select("Donation_ID", "l_linenumber",
                    (F.unix_micros("refund_ts") - F.unix_micros("donation_ts")).alias("micros_after"))


def _donations_t_sql():
    return f"SELECT *, epoch_us({_donation_ts_sql()}) AS t_us FROM donations"


@query("donor_running_history", lambda: with_base(
    f", dt AS ({_donations_t_sql()}) SELECT Donation_ID, count(*) OVER w AS hist_n, "
    + q6("coalesce(sum(Donation_Amount) OVER w, 0)") + " AS hist_sum FROM dt WINDOW w AS (PARTITION BY Donor_ID "
    "ORDER BY t_us, Donation_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def donor_running_history(spark, sf_dir):
    """Count and total of the donor's earlier donations (prefix sums over
    ranges; no single window over a whole donor)."""
    d = P(spark, sf_dir).donations()
    ts = F.to_timestamp(F.concat_ws(" ", F.date_format("Donation_Date", "yyyy-MM-dd"), F.col("Donation_Time")))
    d = d.withColumn("t_us", F.unix_micros(ts))
    h = WN.running_totals(d, ["Donor_ID"], "t_us", "Donation_Amount", tiebreak="Donation_ID")
    return h.select("Donation_ID", "hist_n", r6("hist_sum").alias("hist_sum"))


@query("rolling_structuring", lambda: with_base(
    f", dt AS ({_donations_t_sql()} WHERE Donation_Amount < 500), r AS (SELECT Donation_ID, Donor_ID, "
    f"count(*) OVER w AS n_small_90d, sum(Donation_Amount) OVER w AS s FROM dt WINDOW w AS (PARTITION BY Donor_ID "
    f"ORDER BY t_us RANGE BETWEEN {90 * DAY_US} PRECEDING AND CURRENT ROW)) SELECT Donation_ID, Donor_ID, n_small_90d, "
    + q6("s") + " AS sum_small_90d, CAST(n_small_90d >= 2 AND s >= 950 AS INTEGER) AS structuring_flag FROM r"))
def rolling_structuring(spark, sf_dir):
    """Splitting a large gift into small ones — per donor, the 90-day
    rolling total of gifts under 500; flagged when two or more add up to 950+."""
    d = P(spark, sf_dir).donations().where(F.col("Donation_Amount") < 500)
    ts = F.to_timestamp(F.concat_ws(" ", F.date_format("Donation_Date", "yyyy-MM-dd"), F.col("Donation_Time")))
    d = d.withColumn("t_us", F.unix_micros(ts))
    out = WN.range_sums(d, ["Donor_ID"], "t_us", 90 * DAY_US,
                        {"n_small_90d": F.lit(1), "_s": F.col("Donation_Amount")})
    return out.select("Donation_ID", "Donor_ID", "n_small_90d", r6("_s").alias("sum_small_90d"),
                      ((F.col("n_small_90d") >= 2) & (F.round("_s", 6) >= 950)).cast("int").alias("structuring_flag"))


@query("shared_identifiers", f"WITH ev AS ({EVENTS_SQL}) SELECT ip_key, count(DISTINCT donor_id) AS n_donors, "
       "count(*) AS n_events FROM ev GROUP BY ip_key HAVING count(DISTINCT donor_id) >= 5")
def shared_identifiers(spark, sf_dir):
    """Identifiers (IP keys) shared by many donors, as a distinct count
    per identifier instead of a quadratic self-join of donor pairs."""
    ev = payment_events(spark, sf_dir)
    return (ev.groupBy("ip_key").agg(F.countDistinct("donor_id").alias("n_donors"), F.count("*").alias("n_events"))
            .where(F.col("n_donors") >= 5))
