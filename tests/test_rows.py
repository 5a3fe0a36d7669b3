"""Unit tests of column operators on literal boundary rows."""
from pyspark.sql import functions as F

from giftrisk.operators import triage as TR
from giftrisk.operators.features import amt_ltv_ratio, between_flag, near_threshold
from giftrisk.functions.draws import uniform


def test_near_threshold_boundaries(spark):
    rows = [(495.0, True), (494.99, False), (499.99, True), (500.0, False), (742.5, True), (750.0, False),
            (891.0, True), (899.99, True), (940.5, True), (950.0, False)]
    df = spark.createDataFrame(rows, "a double, want boolean")
    got = df.select(near_threshold(F.col("a")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_hour_flags_with_null(spark):
    df = spark.createDataFrame([(0,), (4,), (5,), (9,), (17,), (18,), (None,)], "h int")
    night = [r[0] for r in df.select(between_flag(F.col("h"), 0, 4)).collect()]
    biz = [r[0] for r in df.select(between_flag(F.col("h"), 9, 17)).collect()]
    assert night == [1, 1, 0, 0, 0, 0, 0]
    assert biz == [0, 0, 0, 1, 1, 0, 0]


def test_tiers_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.2999,), (0.30,), (0.60,), (0.80,), (1.0,), (None,)], "s double")
    got = [r[0] for r in df.select(TR.risk_tier(F.col("s"))).collect()]
    assert got == ["Low", "Low", "Medium", "High", "Critical", "Critical", None]


def test_boost_capped(spark):
    df = spark.createDataFrame([("Fail", "Known Flagged", "chargeback.received", 0.9)],
                               "CVV_Check string, Device_Fingerprint string, Webhook_Event string, b double")
    r = df.select(TR.partner_boost().alias("boost"), TR.boosted_score(F.col("b")).alias("s")).first()
    assert abs(r["boost"] - 0.90) < 1e-12 and r["s"] == 1.0


def test_ratio_null_on_minus_one(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, -1.0)], "a double, l double")
    got = [r[0] for r in df.select(amt_ltv_ratio(F.col("a"), F.col("l"))).collect()]
    assert got == [100.0, None]


def test_draws_independent_of_partitioning(spark):
    df = spark.range(2000)
    a = {r["id"]: r["u"] for r in df.select("id", uniform(F.col("id"), "s", 2).alias("u")).collect()}
    b = {r["id"]: r["u"] for r in df.repartition(13).select("id", uniform(F.col("id"), "s", 2).alias("u")).collect()}
    assert a == b and all(0.0 <= v < 1.0 for v in a.values())


def test_jaro_winkler_known_values():
    from giftrisk.operators.screening import _jaro_winkler
    assert abs(_jaro_winkler("martha", "marhta") - 0.9611111111) < 1e-9
    assert abs(_jaro_winkler("dwayne", "duane") - 0.84) < 1e-9
    assert abs(_jaro_winkler("dixon", "dicksonx") - 0.8133333333) < 1e-9
    assert _jaro_winkler("abc", "abc") == 1.0 and _jaro_winkler("", "abc") == 0.0
