"""Sources and sinks round trips, validation reports, notebook variants and
remaining aggregates (S1-S6, S9, S10, K9, E23, A15, A16, A18, A28, P2, P4,
X17, X18, X20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftrisk import constants as C
from giftrisk.operators import aggregates as AG
from giftrisk.operators import features as FE
from giftrisk.operators import reshape as RS
from giftrisk.operators import screening as SC
from giftrisk.plans.oracle import inlist, u, with_base
from giftrisk.plans.pipeline import Pipeline
from giftrisk.plans.q_screen import _entities_sql, donor_names, entities, latest_donor_names
from giftrisk.plans.q_triage import risk, wr
from giftrisk.plans.registry import q6, query, r6
from giftrisk.session import ensure_checkpoint_dir, write_stage
from giftrisk.sources import bank as BK
from giftrisk.sources import tables as TB

P = Pipeline.get
Y = "Is_Anomalous"


def _scratch(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/sinks/{name}-{uuid.uuid4().hex[:8]}"


DONATION_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c in {"Age", "Donor_Since_Days", "Is_Recurring", "Is_Anonymous",
                                              "Matched_Giving", "Gift_Aid_Eligible", "Refund_Requested",
                                              "IP_Country_Match", "Is_VPN_Or_Proxy", "IP_Velocity_24h"}
                  else T.DoubleType() if c in {"Donation_Amount", "Donor_Lifetime_Value"}
                  else T.DateType() if c == "Donation_Date" else T.StringType())
    for c in C.DONATION_COLUMNS])

_DON_SQL_COLS = ", ".join("CAST(Donation_Date AS VARCHAR) AS Donation_Date" if c == "Donation_Date" else c
                          for c in C.DONATION_COLUMNS)


@query("csv_roundtrip", lambda: with_base(f"SELECT {_DON_SQL_COLS} FROM donations"))
def csv_roundtrip(spark, sf_dir):
    """S2 + S1: donations written as headed CSV (no index) and scanned back
    with the declared schema (never inferred)."""
    path = _scratch(spark, "donations_csv")
    TB.write_csv(P(spark, sf_dir).donations(), path)
    back = TB.read_csv(spark, path, DONATION_SCHEMA)
    return back.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c == "Donation_Date" else F.col(c)
                         for c in C.DONATION_COLUMNS])


# the bank's label in the CSV: urgent orders that were finished
_FRAUD_SQL = "CAST(o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' AS INTEGER)"


def _bank_csv(spark, sf_dir):
    """(transactions, rejected) of the bank transactions written as CSV with Is_Fraud; the
    lines of every 97th order come a second time with an amount that is no number."""
    fraud = (F.col("Transaction_Description") == "1-URGENT") & (F.col("Merchant_Category") == "F")
    rows = P(spark, sf_dir).bank().withColumn("Is_Fraud", fraud.cast("int"))
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in (f.name for f in T.StructType.fromDDL(BK.BANK_SCHEMA))])
    broken = text.where(F.col("Transaction_ID").cast("long") % 97 == 0).withColumn("Transaction_Amount", F.lit("n/a"))
    path = _scratch(spark, "bank_csv")
    TB.write_csv(text.union(broken), path)
    return BK.read_bank_csv(spark, path)


@query("bank_csv_donations", lambda: with_base(
    f"SELECT {_DON_SQL_COLS}, {_FRAUD_SQL} AS Is_Fraud FROM donations d JOIN orders o ON d.Donation_ID = CAST(o.o_orderkey AS VARCHAR)"))
def bank_csv_donations(spark, sf_dir):
    """S1 + P3: the pipeline's reshape fed by a bank CSV; 33 columns, Is_Fraud the last."""
    base = write_stage(RS.remap_base(_bank_csv(spark, sf_dir)[0]), "csv_base")
    a = RS.amount_anchors(base)
    out = RS.enrich(base, a["amt_p90"], a["amt_p95"])
    return out.withColumn("Donation_Date", F.date_format("Donation_Date", "yyyy-MM-dd"))


@query("bank_csv_load_report", "SELECT CAST(count(*) AS BIGINT) AS accepted, CAST(count(*) FILTER (o.o_orderkey % 97 = 0) AS BIGINT) AS rejected, "
       f"CAST(sum({_FRAUD_SQL}) AS BIGINT) AS n_fraud FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def bank_csv_load_report(spark, sf_dir):
    """Lines that fit the schema, lines set apart, and fraud labels."""
    rows, rejected = _bank_csv(spark, sf_dir)
    return (rows.agg(F.count("*").alias("accepted"), F.coalesce(F.sum("Is_Fraud"), F.lit(0)).alias("n_fraud"))
            .crossJoin(rejected.agg(F.count("line").alias("rejected"))).select("accepted", "rejected", "n_fraud"))  # one row each


@query("risk_partitioned_parquet", wr(
    "SELECT Risk_Tier, count(*) AS n, " + q6("max(Risk_Score)") + " AS max_score FROM riskq "
    "WHERE Risk_Tier IN ('Critical', 'High') GROUP BY Risk_Tier"))
def risk_partitioned_parquet(spark, sf_dir):
    """S3 + S4: risk table written partitioned by tier; reading it back with a
    tier filter prunes the other partitions."""
    path = _scratch(spark, "risk")
    TB.write_parquet(risk(spark, sf_dir).select("Donation_ID", "Risk_Score", "Risk_Tier"), path, ["Risk_Tier"])
    back = spark.read.parquet(path).where(F.col("Risk_Tier").isin("Critical", "High"))
    return back.groupBy("Risk_Tier").agg(F.count("*").alias("n"), r6(F.max("Risk_Score")).alias("max_score"))


METRIC_SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("roc_auc", T.DoubleType()),
                              T.StructField("average_precision", T.DoubleType())])


def _metrics_json_sql():
    from giftrisk.plans.q_triage import _cum_sql, _long_sql, _metrics_select, with_risk
    inner = _metrics_select("model")
    return with_risk(f", {_cum_sql(_long_sql(), 'model')}, mcmp AS ({inner}) SELECT model, roc_auc, average_precision FROM mcmp")


@query("metrics_json_roundtrip", _metrics_json_sql)
def metrics_json_roundtrip(spark, sf_dir):
    """Metrics written as JSON and read back with a declared schema."""
    from giftrisk.plans.q_triage import model_comparison
    path = _scratch(spark, "metrics_json")
    TB.write_json(model_comparison(spark, sf_dir).select("model", "roc_auc", "average_precision"), path)
    return spark.read.schema(METRIC_SCHEMA).json(path)


@query("model_save_load")
def model_save_load(spark, sf_dir):
    """A fitted pipeline saved to the shared folder, loaded back and
    used to score."""
    from giftrisk.operators import models as M
    from giftrisk.plans.q_models import _train_test
    _, te = _train_test(spark, sf_dir)
    return M.positive_probability(P(spark, sf_dir).forest().transform(te)).select("Donation_ID", "score")


@query("input_listing")
def input_listing(spark, sf_dir):
    """The input directory listing (file name, bytes) from file metadata."""
    return TB.list_inputs(spark, sf_dir)


@query("pasted_lines", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, trim(unnest(string_split(text, "
       "chr(10)))) AS line FROM documents) WHERE length(line) > 0 GROUP BY doc_id")
def pasted_lines(spark, sf_dir):
    """Newline-separated text -> trimmed non-blank lines (the bulk-screen
    input form), applied to every document's full text."""
    docs = TB.table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select(
        "doc_id", F.trim("line").alias("line")).where(F.length("line") > 0)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


# ---------------------------------------------------------------- K9 reshape validation
_DIST = ["Donor_Country", "Currency", "Donor_Segment", "Donation_Frequency", "Donation_Platform",
         "Payment_Processor", "Campaign_ID"]
_RATES = [("anonymous", "Is_Anonymous = 1"), ("gift_aid", "Gift_Aid_Eligible = 1"),
          ("refund", "Refund_Requested = 1"), ("recurring", "Is_Recurring = 1"), ("matched", "Matched_Giving = 1"),
          ("cvv_fail", "CVV_Check = 'Fail'"), ("device_flagged", "Device_Fingerprint = 'Known Flagged'"),
          ("webhook_ok", "Webhook_Event = 'payment.authorised'"), ("ip_mismatch", "IP_Country_Match = 0"),
          ("vpn", "Is_VPN_Or_Proxy = 1"), ("high_velocity", "IP_Velocity_24h >= 3")]


@query("reshape_value_counts", lambda: with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM donations GROUP BY {c}" for c in _DIST)))
def reshape_value_counts(spark, sf_dir):
    """K9: value counts of the reshaped categorical columns (one scan)."""
    d = P(spark, sf_dir).donations()
    return AG.stack(d, _DIST).groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query("reshape_rates", lambda: with_base(
    "SELECT " + ", ".join(f"{q6(f'avg(CASE WHEN {e} THEN 1.0 ELSE 0.0 END)')} AS {n}" for n, e in _RATES)
    + ", " + q6("avg(CASE WHEN Donor_Country = 'UK' THEN Gift_Aid_Eligible END)") + " AS gift_aid_uk FROM donations"))
def reshape_rates(spark, sf_dir):
    """Validation rates of the enrichment flags, plus the UK-only
    Gift Aid rate (a conditional mean)."""
    d = P(spark, sf_dir).donations()
    exprs = {
        "anonymous": F.col("Is_Anonymous") == 1, "gift_aid": F.col("Gift_Aid_Eligible") == 1,
        "refund": F.col("Refund_Requested") == 1, "recurring": F.col("Is_Recurring") == 1,
        "matched": F.col("Matched_Giving") == 1, "cvv_fail": F.col("CVV_Check") == "Fail",
        "device_flagged": F.col("Device_Fingerprint") == "Known Flagged",
        "webhook_ok": F.col("Webhook_Event") == "payment.authorised", "ip_mismatch": F.col("IP_Country_Match") == 0,
        "vpn": F.col("Is_VPN_Or_Proxy") == 1, "high_velocity": F.col("IP_Velocity_24h") >= 3,
    }
    return d.agg(*[r6(F.avg(F.when(e, 1.0).otherwise(0.0))).alias(n) for n, e in exprs.items()],
                 r6(F.avg(F.when(F.col("Donor_Country") == "UK", F.col("Gift_Aid_Eligible")))).alias("gift_aid_uk"))


@query("gbp_amount_profile", lambda: with_base(
    "SELECT count(*) AS n, " + q6("avg(Donation_Amount)") + " AS mean, " + q6("stddev_samp(Donation_Amount)")
    + " AS std, min(Donation_Amount) AS min, " + q6("quantile_cont(Donation_Amount, 0.5)") + " AS median, "
    "max(Donation_Amount) AS max FROM donations WHERE Currency = 'GBP'"))
def gbp_amount_profile(spark, sf_dir):
    """describe() of the GBP donation amounts (filter pushed to the scan)."""
    d = P(spark, sf_dir).donations().where(F.col("Currency") == "GBP")
    x = F.col("Donation_Amount")
    med = AG.group_quantiles(d, "Donation_Amount", {"median": 0.5})[(None, "median")]
    return d.agg(F.count("*").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"),
                 F.min(x).alias("min"), r6(F.lit(med)).alias("median"), F.max(x).alias("max"))


# ---------------------------------------------------------------- E23 notebook variants
@query("features_notebook_variant", lambda: with_base(
    ", dv AS (SELECT Donor_ID AS d, sum(Donation_Amount) AS cum FROM donations GROUP BY Donor_ID) "
    "SELECT Donation_ID, CAST(coalesce(hour(try_strptime(Donation_Time, '%H:%M:%S')) BETWEEN 0 AND 5, false) "
    "AS INTEGER) AS Is_Night_Donation, CAST(Donation_Amount % 100 = 0 AS INTEGER) AS Is_Round_Amount, "
    f"CAST(Donation_Platform IN {inlist(['Virtual Card', 'QR Code', 'Chatbot'])} AS INTEGER) AS High_Risk_Platform, "
    + q6("Donation_Amount / (cum + 1)") + " AS Amount_to_Cumulative_Ratio FROM donations JOIN dv ON Donor_ID = d"))
def features_notebook_variant(spark, sf_dir):
    """The notebook's parameter variants (night 0-5, round to 100, three
    platforms) and amount / (donor cumulative + 1) via aggregate-then-join."""
    p = P(spark, sf_dir)
    d = p.donations()
    f = FE.add_features(d, p.anchors(), night=(0, 5), round_modulus=100,
                        high_risk=["Virtual Card", "QR Code", "Chatbot"])
    cum = d.groupBy("Donor_ID").agg(F.sum("Donation_Amount").alias("_cum"))
    return f.join(cum, "Donor_ID").select(
        "Donation_ID", "Is_Night_Donation", "Is_Round_Amount", "High_Risk_Platform",
        r6(F.col("Donation_Amount") / (F.col("_cum") + 1)).alias("Amount_to_Cumulative_Ratio"))


# ---------------------------------------------------------------- A15 / A16 / A18 / A28
@query("profile_by_label", wr(
    "SELECT Is_Anomalous, count(*) AS n, " + q6("avg(Donation_Amount)") + " AS mean, "
    + q6("stddev_samp(Donation_Amount)") + " AS std, min(Donation_Amount) AS min, max(Donation_Amount) AS max "
    "FROM riskq GROUP BY Is_Anomalous"))
def profile_by_label(spark, sf_dir):
    """Grouped profile of the amount by label."""
    x = F.col("Donation_Amount")
    return (P(spark, sf_dir).labeled().groupBy(Y).agg(
        F.count("*").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max")))


_TYPES = ["Bank Transfer", "Card", "Direct Debit", "Gift", "Refund"]


@query("type_by_label_pivot", wr(
    "SELECT Is_Anomalous, " + ", ".join(
        f"count_if(Donation_Type = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM riskq GROUP BY Is_Anomalous"))
def type_by_label_pivot(spark, sf_dir):
    """Unstack donation type counts by label into a wide table (pivot with
    the value list given, so no extra pass to find the values)."""
    return (P(spark, sf_dir).labeled().groupBy(Y).pivot("Donation_Type", _TYPES).agg(F.count(F.lit(1)))
            .na.fill(0, _TYPES))


@query("approx_distinct")
def approx_distinct(spark, sf_dir):
    """A18 (sketch form): HyperLogLog++ distinct counts of donors, names and IPs."""
    d = P(spark, sf_dir).donations()
    return d.agg(F.approx_count_distinct("Donor_ID", 0.01).alias("donors"),
                 F.approx_count_distinct("Donor_Name", 0.01).alias("names"),
                 F.approx_count_distinct("Campaign_ID").alias("campaigns"))


@query("approx_quantiles")
def approx_quantiles(spark, sf_dir):
    """A5 at scale: percentile_approx of the anchors (accuracy 1e4)."""
    d = P(spark, sf_dir).donations()
    q = F.percentile_approx("Donation_Amount", [0.75, 0.9, 0.95], 10000)
    return d.agg(q.alias("q")).select(F.col("q")[0].alias("amt_p75"), F.col("q")[1].alias("amt_p90"),
                                      F.col("q")[2].alias("amt_p95"))


@query("screening_summary", lambda: with_base(_entities_sql() + (
    "SELECT count(*) AS screened, count_if(b) AS blocked, count(*) - count_if(b) AS clear FROM ("
    "SELECT DISTINCT Donor_ID, Donor_ID IN (SELECT name_id FROM hits) AS b FROM donations)")))
def screening_summary(spark, sf_dir):
    """Screened / blocked / clear counts."""
    hits = SC.fuzzy_hits(donor_names(spark, sf_dir), entities(spark, sf_dir))
    st = SC.screening_status(latest_donor_names(spark, sf_dir), hits)
    return st.agg(F.count("*").alias("screened"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"),
                  F.count_if(F.col("status") != "BLOCKED").alias("clear"))


# ---------------------------------------------------------------- display
_DISPLAY = {"Risk_Score": "Risk Score", "Risk_Tier": "Tier", "Is_Anomalous": "Confirmed", "Flagged": "Flagged",
            "Log_Donation_Amount": "Log Amount", "Amt_Bal_Ratio": "Amt/Balance", "Is_Night_Donation": "Night",
            "High_Risk_Platform": "Hi-Risk Platform", "Is_Transfer": "Transfer",
            "Low_Balance_Large_Gift": "Low Bal+Large"}


@query("triage_display", wr(
    "SELECT Donation_ID, printf('%.4f', Risk_Score) AS \"Risk Score\", Risk_Tier AS Tier, Is_Anomalous AS Confirmed, "
    + q6("Log_Donation_Amount", 4) + " AS \"Log Amount\", Is_Night_Donation AS Night, "
    "High_Risk_Platform AS \"Hi-Risk Platform\", Is_Transfer AS Transfer, Low_Balance_Large_Gift AS \"Low Bal+Large\", "
    "CASE WHEN len(Fired_Terms) = 0 THEN '—' ELSE replace(array_to_string(Fired_Terms, ', '), '_', ' ') END "
    "AS \"Fired Rules\" FROM riskq WHERE Risk_Tier IN ('Critical', 'High') ORDER BY Risk_Score DESC, Donation_ID "
    "LIMIT 30"))
def triage_display(spark, sf_dir):
    """T-g display: display-name renames of the columns that exist (P4 keeps
    only existing ones), score as 4-decimal text, fired rules joined with
    '—' for none and underscores as spaces."""
    from giftrisk.operators import triage as TR
    q = TR.triage_queue(risk(spark, sf_dir), ["Critical", "High"], 30)
    keep = [c for c in _DISPLAY if c in q.columns]
    fired = F.when(F.size("Fired_Terms") == 0, F.lit("—")).otherwise(
        F.replace(F.array_join("Fired_Terms", ", "), F.lit("_"), F.lit(" ")))
    out = q.select("Donation_ID", *keep, fired.alias("Fired Rules")).withColumnsRenamed(
        {c: _DISPLAY[c] for c in keep})
    return out.withColumns({"Risk Score": F.format_string("%.4f", F.col("Risk Score")),
                            "Log Amount": r6("Log Amount", 4)})



@query("rate_sum_count_by_segment", wr(
    "SELECT Donor_Segment, CAST(sum(Is_Anomalous) AS BIGINT) AS n_anomalous, count(*) AS n, "
    + q6("sum(Is_Anomalous) / count(*)") + " AS rate FROM riskq GROUP BY Donor_Segment"))
def rate_sum_count_by_segment(spark, sf_dir):
    """A3: grouped sum and count with the rate derived afterwards."""
    g = P(spark, sf_dir).labeled().groupBy("Donor_Segment").agg(
        F.sum(Y).cast("bigint").alias("n_anomalous"), F.count("*").alias("n"))
    return g.withColumn("rate", r6(F.col("n_anomalous") / F.col("n")))


@query("schema_report")
def schema_report(spark, sf_dir):
    """Column names, types and the row count of the donation table."""
    d = P(spark, sf_dir).donations()
    n = d.count()
    rows = [(i, f.name, f.dataType.simpleString(), n) for i, f in enumerate(d.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, n_rows long")


def _dayfirst_text():
    from giftrisk.functions.draws import uniform
    good = F.date_format("Donation_Date", "dd-MM-yyyy")
    return F.when(uniform(F.col("Donation_ID"), "badtext", 0) < 0.01, F.lit("31-02-2024")).otherwise(good)


@query("day_first_parse", lambda: with_base(
    ", t AS (SELECT Donation_ID, CASE WHEN " + u("Donation_ID", "badtext", 0) + " < CAST(0.01 AS DOUBLE) THEN '31-02-2024' ELSE strftime(Donation_Date, "
    "'%d-%m-%Y') END AS raw FROM donations) SELECT Donation_ID, raw, CAST(CAST(try_strptime(raw, '%d-%m-%Y') AS DATE) "
    "AS VARCHAR) AS parsed FROM t"))
def day_first_parse(spark, sf_dir):
    """Day-first date text parsed with an explicit pattern; impossible
    dates become NULL instead of failing the job."""
    d = P(spark, sf_dir).donations().select("Donation_ID", _dayfirst_text().alias("raw"))
    return d.select("Donation_ID", "raw", F.date_format(FE.parse_day_first(F.col("raw")), "yyyy-MM-dd").alias("parsed"))
