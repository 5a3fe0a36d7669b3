import numpy as np
from pyspark.sql import functions as F

from giftrisk.operators.quantiles import OrderStat, exact_quantiles, first_k_mask, order_stats


def test_order_stats_match_numpy_with_ties(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.exponential(100, 5000), 0)  # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    ks = [0, 1, 2499, 4998, 4999]
    got = order_stats(df, {str(k): OrderStat(F.col("x"), k) for k in ks})
    srt = np.sort(vals)
    for k in ks:
        assert got[str(k)] == srt[k]


def test_exact_quantiles_linear_interpolation(spark):
    vals = [1.0, 2.0, 2.0, 5.0, 10.0, 11.0, 30.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, {"p75": (F.col("x"), 0.75), "p10": (F.col("x"), 0.10), "p50": (F.col("x"), 0.5)})
    for name, p in [("p75", 0.75), ("p10", 0.10), ("p50", 0.5)]:
        assert abs(q[name] - float(np.percentile(vals, p * 100))) < 1e-12


def test_first_k_mask_exact_count_with_ties(spark):
    df = spark.createDataFrame([(i % 3, f"id{i:03d}") for i in range(100)], "d long, id string")
    m = first_k_mask(df, F.col("d"), F.col("id"), 40)
    picked = sorted(r["id"] for r in df.where(m).collect())
    expected = sorted(sorted(((i % 3, f"id{i:03d}") for i in range(100)))[:40], key=lambda t: t[1])
    assert picked == sorted(t[1] for t in expected)
    assert df.where(first_k_mask(df, F.col("d"), F.col("id"), 0)).count() == 0


def test_large_brackets_and_ties_are_narrowed_down(spark, monkeypatch):
    from giftrisk.operators import quantiles as Q
    monkeypatch.setattr(Q, "MAX_ORDERED", 500)
    monkeypatch.setattr(Q, "_accuracy", lambda n: 20)
    rng = np.random.default_rng(2)
    vals = np.where(rng.random(6000) < 0.1, 7.5, rng.normal(size=6000) * 10)  # a tenth ties
    df = spark.createDataFrame([(float(v), f"id{i:05d}") for i, v in enumerate(vals)], "x double, id string").repartition(5)
    ks = [0, 17, 3000, 4600, 5999]
    got = order_stats(df, {str(k): OrderStat(F.col("x"), k) for k in ks})
    assert [got[str(k)] for k in ks] == np.sort(vals)[ks].tolist()
    one = df.withColumn("d", F.lit(3).cast("long"))
    m = first_k_mask(one, F.col("d"), F.col("id"), 2345)
    assert sorted(r.id for r in one.where(m).select("id").collect()) == [f"id{i:05d}" for i in range(2345)]
