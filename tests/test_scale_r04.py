"""Steps of the round: the base stages' writes, shared sketches, spread name pairs."""

import numpy as np
from pyspark.sql import functions as F

from giftrisk.functions.draws import hash_columns
from giftrisk.operators import aggregates as AG
from giftrisk.operators import labels as L
from giftrisk.operators import quantiles as Q
from giftrisk.operators import reshape as R
from giftrisk.operators import rules as RU
from giftrisk.operators import screening as SC
from giftrisk.plans import pipeline as PL
from giftrisk.sources.bank import clock

SMOKE = "/root/testdata/sf0.001"


def test_scores_and_noise_have_no_table_of_their_own(spark, monkeypatch):
    names, write = [], PL.write_stage
    monkeypatch.setattr(PL, "write_stage", lambda df, name, *a: names.append(name) or write(df, name, *a))
    p = PL.Pipeline(spark, SMOKE)
    got = p.labeled()
    assert sorted(names) == ["donation_amounts", "donations", "labeled"]
    want = L.assign_labels(L.add_noise(p.scored(), {}))
    assert got.columns == want.columns
    some = ["Donation_ID", "Donation_Amount", "Is_Night_Donation", "R4_10", "Rule_Score", "Score_Noisy", "Label_Flipped", "Is_Anomalous"]
    assert sorted(got.select(*some).collect()) == sorted(want.select(*some).collect())
    assert p.donations().columns == p.scored().columns[:len(p.donations().columns)]


def test_rule_score_without_the_list_of_terms_is_the_same(spark):
    p = PL.Pipeline.get(spark, SMOKE)
    keep = ["Donation_ID", "Rule_Score", *[f"{r}_10" for r in RU.RULE_IDS]]
    a, b = (sorted(RU.score_rules(p.donations(), p.anchors(), keep_terms=k).select(*keep).collect()) for k in (True, False))
    assert a == b and len(a) > 0


def test_no_hash_text_is_copied_through_the_reshape(spark):
    base = R.remap_base(PL.Pipeline.get(spark, SMOKE).bank())
    assert not [c for c in base.columns if c in hash_columns({"order": F.lit(""), "cust": F.lit("")})]


def test_time_of_day_as_text(spark):
    rows = spark.createDataFrame([(0,), (59,), (3661,), (86399,), (None,)], "s int").select(clock(F.col("s")).alias("t"))
    assert [r.t for r in rows.collect()] == ["00:00:00", "00:00:59", "01:01:01", "23:59:59", "null:null:null"]


def test_ranks_of_the_same_values_share_a_sketch_and_a_scan(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=30_000).round(4)
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(x)], "x double, g int").repartition(5)
    calls, sketch = [], F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: calls.append(a) or sketch(*a))
    c, w = F.col("x"), F.col("g") == 1
    got = Q.exact_quantiles(df, {"a": (c, 0.5), "b": (c, 0.901), "c": (c, 0.25)}, {"c": w})
    assert len(calls) == 2
    assert np.allclose([got["a"], got["b"], got["c"]], [np.quantile(x, 0.5), np.quantile(x, 0.901), np.quantile(x[1::3], 0.25)], atol=0)


def test_correlations_of_more_columns_than_an_aggregate_takes(spark):
    r = np.random.default_rng(2).normal(size=(400, AG.CORRELATED * 2 + 1))
    names = [f"c{i}" for i in range(r.shape[1])]
    df = spark.createDataFrame([(*map(float, v), int(v[0] + v[1] > 0)) for v in r], ", ".join(f"{n} double" for n in names) + ", y int")
    y = (r[:, 0] + r[:, 1] > 0).astype(float)
    got = [(q.feature, q["corr"]) for q in AG.correlations(df, names, "y").collect()]
    assert sorted(n for n, _ in got) == sorted(names)
    assert all(abs(v - np.corrcoef(r[:, names.index(n)], y)[0, 1]) < 1e-9 for n, v in got)
    assert [abs(v) for _, v in got] == sorted((abs(v) for _, v in got), reverse=True)


def test_candidate_pairs_of_names_are_spread_over_tasks(spark):
    left = spark.range(300).select(F.concat(F.lit("maria "), F.conv("id", 10, 16)).alias("na"))
    pairs = SC.similar_names(left, left.withColumnRenamed("na", "ne"), 0.75)
    plan = pairs._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
    brute = left.crossJoin(left.withColumnRenamed("na", "ne")).where(SC.similarity("na", "ne") >= 0.75)
    assert pairs.select("na", "ne").exceptAll(brute).count() == 0 and pairs.count() == brute.count()


def test_model_queue_reads_wide_rows_of_its_own_ids_only(spark, monkeypatch):
    from giftrisk.plans import q_model_reports as MR
    from giftrisk.operators import triage as TR
    p = PL.Pipeline(spark, SMOKE)
    scores = p.labeled().select("Donation_ID", "Is_Anomalous", (F.col("Rule_Score") / 20).alias("RF_Score"))
    twice = scores.unionByName(scores.limit(40))  # keys may repeat
    p._risk_scores = PL.write_stage(twice, "risk_scores")
    monkeypatch.setattr(MR, "P", lambda *a: p)
    seen, risk = [], MR.model_risk
    monkeypatch.setattr(MR, "model_risk", lambda s, d, only=None: seen.append(only) or risk(s, d, only))
    got = MR.model_triage_queue(spark, SMOKE)
    want = TR.triage_queue(risk(spark, SMOKE), ["Critical", "High"], 30).select("Donation_ID", "Risk_Score")
    assert got.select("Donation_ID", "Risk_Score").collect() == want.collect() and got.count() == 30
    assert seen[-1] is not None and seen[-1].count() <= 30
