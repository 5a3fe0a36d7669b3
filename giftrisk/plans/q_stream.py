"""Streaming queries (T1-T8), run with availableNow into a Parquet sink and
returned as batch DataFrames (rows-only checks; batch twins are exact)."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.q_triage import wr
from giftrisk.plans.q_windows import EVENTS_SQL, REVERSAL_SQL
from giftrisk.plans.registry import q6, query, r6
from giftrisk.streaming import detectors as S

P = Pipeline.get


_EV_TS = ("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS donor_id, json_extract_string(props, '$.k') AS ip_key, "
          "CASE event_type WHEN 'error' THEN 'payment.declined' ELSE event_type END AS ev, value FROM events")
_WM = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("stream_velocity", f"WITH ev AS ({_EV_TS}), w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ws, "
       "ip_key FROM ev, range(24) r(k)) SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, ip_key, count(*) AS n "
       f"FROM w WHERE ws + INTERVAL 24 HOUR <= {_WM} GROUP BY ws, ip_key")
def stream_velocity(spark, sf_dir):
    """Sliding 24 h IP velocity with a watermark."""
    out = S.run_to_table(S.ip_velocity(S.event_stream(spark, sf_dir)), "velocity")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "ip_key", "n")


@query("stream_burst", f"WITH ev AS ({_EV_TS} WHERE event_type = 'error'), w AS (SELECT date_trunc('hour', ts) - "
       "k * INTERVAL 1 HOUR AS ws, donor_id FROM ev, range(6) r(k)) SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS "
       f"window_start, donor_id, count(*) AS n_declines FROM w WHERE ws + INTERVAL 6 HOUR <= {_WM} "
       "GROUP BY ws, donor_id HAVING count(*) >= 3")
def stream_burst(spark, sf_dir):
    """Declined-payment bursts per donor."""
    out = S.run_to_table(S.decline_bursts(S.event_stream(spark, sf_dir)), "burst")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "donor_id",
                      "n_declines")


@query("stream_sessions", f"WITH ev AS ({_EV_TS}), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY donor_id "
       "ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM ev), s AS (SELECT *, sum(brk) OVER "
       "(PARTITION BY donor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), t AS (SELECT donor_id, sid, "
       "min(ts) AS ss, max(ts) + INTERVAL 30 MINUTE AS se, count(*) AS n_events FROM s GROUP BY donor_id, sid) "
       "SELECT strftime(ss, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(se, '%Y-%m-%d %H:%M:%S.%f') AS "
       f"session_end, donor_id, n_events FROM t WHERE se <= {_WM}")
def stream_sessions(spark, sf_dir):
    """T3 session form: session windows per donor."""
    out = S.run_to_table(S.sessions(S.event_stream(spark, sf_dir)), "sessions")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select(F.date_format("session_start", fmt).alias("session_start"),
                      F.date_format("session_end", fmt).alias("session_end"), "donor_id", "n_events")


@query("stream_reversal_join", f"WITH ev AS ({EVENTS_SQL}) SELECT a.event_id AS auth_id, r.event_id AS rev_id, "
       "a.donor_id FROM ev a JOIN ev r ON a.donor_id = r.donor_id AND a.webhook_event = 'payment.authorised' AND "
       "r.webhook_event = 'payment.reversed' AND r.t_us BETWEEN a.t_us AND a.t_us + 3600000000")
def stream_reversal_join(spark, sf_dir):
    """T4: stream-stream interval join authorised -> reversed within 1 h."""
    out = S.run_to_table(S.reversal_join(S.event_stream(spark, sf_dir)), "reversal")
    return out.select("auth_id", "rev_id", "donor_id")


@query("stream_first_reversal", REVERSAL_SQL)
def stream_first_reversal(spark, sf_dir):
    """T4 as-of form: each authorised payment with the first reversal by the same donor
    within 1 h, from state; equal to the batch twin ``reversal_interval_join``."""
    out = S.merge_first_reversals(S.run_to_table(S.first_reversals(S.event_stream(spark, sf_dir)), "first_reversal"))
    return out.select(F.col("auth_id").alias("auth_event_id"), "donor_id", (F.col("rev_us") - F.col("auth_us")).alias("micros_to_reversal"))


@query("stream_dedup", "SELECT DISTINCT event_id, user_id AS donor_id FROM events")
def stream_dedup(spark, sf_dir):
    """De-duplicated webhook deliveries (late rows dropped by the watermark)."""
    return S.run_to_table(S.deduplicate(S.event_stream(spark, sf_dir)), "dedup").select("event_id", "donor_id")


@query("stream_donor_state", "SELECT user_id AS donor_id, count(*) AS n_events, " + q6("sum(value)")
       + " AS total_amount, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM events GROUP BY user_id")
def stream_donor_state(spark, sf_dir):
    """Running per-donor state with applyInPandasWithState."""
    out = S.merge_donor_state(S.run_to_table(S.donor_state(S.event_stream(spark, sf_dir)), "donor_state"))
    return out.select("donor_id", "n_events", r6("total_amount").alias("total_amount"),
                      F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


@query("stream_features", wr(f"SELECT Donation_ID, Rule_Score, {q6('Risk_Score')} AS Risk_Score, Risk_Tier FROM riskq"))
def stream_features(spark, sf_dir):
    """The batch scoring columns applied to a stream of donation files."""
    p = P(spark, sf_dir)
    d = p.donations()
    path = p.paths["donations"]
    stats = p.labeled().agg(F.min("Rule_Score"), F.max("Rule_Score")).first()
    scored = S.score_stream(S.donation_stream(spark, path, d.schema), p.anchors(), stats[0], stats[1])
    out = S.run_to_table(scored.select("Donation_ID", "Rule_Score", "Risk_Score", "Risk_Tier"), "features")
    return out.select("Donation_ID", "Rule_Score", r6("Risk_Score").alias("Risk_Score"), "Risk_Tier")
