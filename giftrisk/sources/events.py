"""Payment events and refunds derived from the driver's events / lineitem
tables (webhook-style events keyed by donor, IP key and device)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.sources.bank import literal_map
from giftrisk.sources.tables import table


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_ts (timestamp, UTC), t_us (epoch micros), donor_id,
    ip_key, device_id, webhook_event, amount."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", ts.alias("event_ts"), F.unix_micros(ts).alias("t_us"), F.col("user_id").alias("donor_id"),
        k.alias("ip_key"), F.concat(F.lit("dev-"), k).alias("device_id"),
        literal_map(C.EVENT_TO_WEBHOOK)[F.col("event_type")].alias("webhook_event"),
        F.col("value").alias("amount"))


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as refund requests: donation id, refund time, amount."""
    li = table(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").cast("string").alias("Donation_ID"), "l_linenumber",
                    F.col("l_shipdate").cast("timestamp").alias("refund_ts"),
                    F.col("l_extendedprice").alias("refund_amount")))
